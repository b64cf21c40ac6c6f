"""Quality rules with robust multivariate outliers. DataFrame operations only.

Base statistics of each text become a vector of transformed statistics. For each pair of language and source the
minimum-covariance-determinant estimate is found by concentration steps from two starts (medians with
quartile ranges; plain moments): keep the share CORE of rows that lie nearest by Mahalanobis distance, estimate anew, and repeat until no
estimate's determinant changes by more than SETTLED (two to four steps as a rule, STEPS at most). Of
the starts the one with the smaller determinant stays. Rows beyond CUTOFF by that estimate are rejected.

Vectors are whole numbers of thousandths and their sums are whole numbers too, so reruns agree to
the last bit. The nearest rows are found from counts by classes of distance, so no group is ever gathered:
each step sums moments by (group, class), at most CLASSES rows a group.

Null and empty texts have no words and fail the base rules. Null languages and sources are groups of their own. Groups of fewer
than LEAST rows that pass the base rules are judged by the estimate of all rows of their language, and languages of fewer by that
of all rows, however few these are: every row that passes the base rules gets a verdict. Repeated rows are each judged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.common import SPACE, dropped, words, written

CORE, STEPS, LEAST, CLASSES = 0.75, 20, 40, 1300
#: Change of the log of a determinant's root below which an estimate counts as settled; classes of distance let smaller ones go on for ever.
SETTLED = 0.01
#: Groups whose estimates (some 30 numbers each) may be broadcast.
SMALL = 20_000
#: The statistics and, in thousandths, the least deviation that each is granted.
STATS = {"length": 60, "symbols": 50, "repeats": 150, "capitals": 60, "marks": 60}
#: Squared distance beyond which a row is rejected, and the factor that makes the core's covariance consistent for five dimensions.
CUTOFF, CONSISTENCY = 16.0, 1.42
P = len(STATS)
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]


def base_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, capitals, marks."""
    t = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    t = t.withColumn("ws", words(F.col("t"))).withColumn("lines", F.filter(F.split("t", "\n", -1), lambda x: x.rlike(rf"[^{SPACE}]")))
    t = t.withColumn("n", F.size("ws"))
    # windows by hash; only texts in which a hash comes twice go through the exact comparison below
    t = t.withColumn("wh", F.when(F.col("n") >= 8, F.transform(F.sequence(F.lit(1), F.col("n") - 7), lambda i: F.xxhash64(F.slice("ws", i, 8)))).otherwise(F.array().cast("array<bigint>")))
    t = t.withColumn("twice", F.size(F.array_distinct("wh")) < F.size("wh"))
    t = t.withColumn("sorted", F.when(F.col("twice"), F.sort_array(F.transform("wh", lambda h, i: F.struct(h.alias("h"), F.slice("ws", i + 1, 8).alias("w"), i.alias("i"))))))
    same = lambda x, y: (x["h"] == y["h"]) & (x["w"] == y["w"])
    t = t.withColumn("at", F.when(F.col("twice"), F.sort_array(F.transform(F.filter("sorted", lambda x, j: F.coalesce(same(x, F.get("sorted", j - 1)), F.lit(False)) | F.coalesce(same(x, F.get("sorted", j + 1)), F.lit(False))), lambda x: x["i"]))))
    covered = F.aggregate(F.transform("at", lambda p, j: F.least(F.lit(8), F.coalesce(F.get("at", j + 1) - p, F.lit(8)))), F.lit(0), lambda a, x: a + x)
    count = lambda what: F.regexp_count("t", F.lit(what)).cast("bigint")
    return t.select(
        "doc_id", "lang", "source", F.col("n").cast("bigint").alias("n_words"), F.length(F.array_join("ws", "")).cast("bigint").alias("word_chars"), count(r"[#*$%&|<>]").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"), F.coalesce(F.when(F.size("at") > 0, covered), F.lit(0)).cast("bigint").alias("n_repeat_words"),
        count(r"\p{Lu}").alias("capitals"), count(r"[^\p{L}\p{N}#*$%&|<>\s]").alias("marks"),
    )


def vector(b: DataFrame) -> DataFrame:
    """Adds the columns of STATS in thousandths. Short texts are drawn to common values, as if PRIOR more words had been read."""
    prior, n, c = 30.0, F.col("n_words"), F.col("word_chars")
    share = lambda k, of, usual: F.sqrt((F.col(k) + usual * prior * 5) / (of + prior * 5))
    x = {
        "length": F.log((c + 5 * prior) / (n + prior)),
        "symbols": share("n_symbols", c, 0.0),
        "repeats": F.sqrt(F.col("n_repeat_words") / (n + prior)),
        "capitals": share("capitals", c, 0.02),
        "marks": share("marks", c, 0.02),
    }
    return b.select("*", *(F.round(v * 1000).cast("bigint").alias(f"x_{k}") for k, v in x.items()))


X = [f"x_{k}" for k in STATS]
MEANS, FACTORS = [f"m{i}" for i in range(P)], [f"l{i}{j}" for i, j in PAIRS]


def _factored(s: DataFrame, cov: dict[tuple[int, int], Column], keep: list[str]) -> DataFrame:
    """Cholesky factor l_ij of a covariance with the least deviations added, and det, the product of its diagonal's squares."""
    floors = list(STATS.values())
    s = s.select(*keep, *(cov[i, j].alias(f"c{i}{j}") + (F.lit(float(floors[i]) ** 2) if i == j else F.lit(0.0)) for i, j in PAIRS)).toDF(*keep, *(f"c{i}{j}" for i, j in PAIRS))
    for j in range(P):
        done = sum((F.col(f"l{j}{k}") ** 2 for k in range(j)), F.lit(0.0))
        s = s.withColumn(f"l{j}{j}", F.sqrt(F.greatest(F.col(f"c{j}{j}") - done, F.lit(1.0))))
        for i in range(j + 1, P):
            s = s.withColumn(f"l{i}{j}", (F.col(f"c{i}{j}") - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))) / F.col(f"l{j}{j}"))
    logdet = sum((F.log(f"l{j}{j}") for j in range(P)), F.lit(0.0))
    return s.withColumn("logdet", logdet).select(*keep, *FACTORS, "logdet")


def _distance(v: DataFrame) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance, by forward substitution."""
    for i in range(P):
        v = v.withColumn(f"z{i}", (F.col(X[i]) - F.col(MEANS[i]) - sum((F.col(f"l{i}{k}") * F.col(f"z{k}") for k in range(i)), F.lit(0.0))) / F.col(f"l{i}{i}"))
    return v.withColumn("d2", sum((F.col(f"z{i}") ** 2 for i in range(P)), F.lit(0.0))).drop(*(f"z{i}" for i in range(P)))


def _moments() -> list[Column]:
    return [F.count("*").alias("n"), *(F.sum(x).alias(f"s{i}") for i, x in enumerate(X)), *(F.sum(F.col(X[i]) * F.col(X[j])).alias(f"q{i}{j}") for i, j in PAIRS)]


def _estimate(s: DataFrame) -> DataFrame:
    """Sums n, s_i, q_ij of (g, start) -> means and factor."""
    s = s.select("g", "start", *((F.col(f"s{i}") / F.col("n")).alias(m) for i, m in enumerate(MEANS)), *((F.col(f"q{i}{j}") / F.col("n")).alias(f"e{i}{j}") for i, j in PAIRS))
    return _factored(s, {(i, j): F.col(f"e{i}{j}") - F.col(MEANS[i]) * F.col(MEANS[j]) for i, j in PAIRS}, ["g", "start", *MEANS])


def _with(v: DataFrame, params: DataFrame, how: str = "inner") -> DataFrame:
    """v joined to estimates by group; they are broadcast only if their number is small."""
    return v.join(F.broadcast(params) if params.count() <= SMALL else params, "g", how)


def _total(array: str, field: str) -> Column:
    return F.aggregate(array, F.lit(0).cast("bigint"), lambda acc, x: acc + x[field])


def robust_estimates(spark: SparkSession, v: DataFrame) -> DataFrame:
    """(g, x_...) rows -> g, means, factor: the estimate of each group."""
    quart = v.groupBy("g").agg(*(F.expr(f"percentile({x}, array(0.25, 0.5, 0.75))").alias(f"p{i}") for i, x in enumerate(X)))
    a = quart.select("g", F.lit(0).alias("start"), *(F.col(f"p{i}")[1].alias(m) for i, m in enumerate(MEANS)), *(F.pow((F.col(f"p{i}")[2] - F.col(f"p{i}")[0]) / 1.349, F.lit(2.0)).alias(f"w{i}") for i in range(P)))
    a = _factored(a, {(i, j): F.col(f"w{i}") if i == j else F.lit(0.0) for i, j in PAIRS}, ["g", "start", *MEANS])
    b = _estimate(v.groupBy("g").agg(*_moments()).withColumn("start", F.lit(1)))
    params = written(spark, a.unionByName(b), "estimate")
    fields = ["n", *(f"s{i}" for i in range(P)), *(f"q{i}{j}" for i, j in PAIRS)]
    for _ in range(STEPS):
        near = _distance(_with(v.select("g", *X), params)).withColumn("class", F.least(F.lit(CLASSES), F.floor(F.log1p("d2") * 64)).cast("int"))
        sums = near.groupBy("g", "start", "class").agg(*_moments())
        sums = sums.groupBy("g", "start").agg(F.sort_array(F.collect_list(F.struct("class", *fields))).alias("all"), F.sum("n").alias("total"))
        # the last class that still begins within the core
        start = F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(-1).alias("cut"))
        cut = F.aggregate("all", start, lambda acc, x: F.struct((acc["seen"] + x["n"]).alias("seen"), F.when(acc["seen"] < F.ceil(F.col("total") * CORE), x["class"]).otherwise(acc["cut"]).alias("cut")))["cut"]
        sums = sums.withColumn("cut", cut).withColumn("core", F.filter("all", lambda x: x["class"] <= F.col("cut")))
        sums = sums.select("g", "start", *(_total("core", f).alias(f) for f in fields))
        new = written(spark, _estimate(sums), "estimate")
        moved = new.join(params.select("g", "start", F.col("logdet").alias("was")), ["g", "start"]).agg(F.max(F.abs(F.col("logdet") - F.col("was")))).first()[0]
        dropped(spark, params)
        params = new
        if not moved or moved < SETTLED:
            break
    best = F.min_by(F.struct(*MEANS, *FACTORS), F.struct("logdet", "start"))
    return params.groupBy("g").agg(best.alias("b")).select("g", "b.*")


def pools(v: DataFrame) -> DataFrame:
    """(g, l, base_failed) rows -> g, own: the pool whose estimate judges the group, fed: the pools with an estimate that its rows belong to."""
    groups = v.groupBy("g", "l").agg(F.sum(F.when(F.col("base_failed"), 0).otherwise(1)).alias("n"))
    langs = groups.groupBy("l").agg(F.sum("n").alias("n_l"), (F.min("n") < LEAST).alias("short"))
    langs = langs.crossJoin(F.broadcast(langs.agg(F.coalesce(F.max(F.col("n_l") < LEAST), F.lit(False)).alias("rest"))))
    enough, enough_l = F.col("n") >= LEAST, F.col("n_l") >= LEAST
    fed = F.array_compact(F.array(F.when(enough, F.col("g")), F.when(enough_l & F.col("short"), F.col("l")), F.when(F.col("rest"), F.lit("all"))))
    own = F.when(enough, F.col("g")).when(enough_l, F.col("l")).otherwise(F.lit("all"))
    return groups.join(langs, "l").select("g", own.alias("own"), fed.alias("fed"))


def judge(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance of every row."""
    b = base_statistics(docs)
    b = b.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    v = vector(b).withColumn("g", F.to_json(F.struct("lang", "source"))).withColumn("l", F.concat(F.lit("lang "), F.to_json(F.struct("lang")))).drop("lang", "source")
    v = written(spark, v, "vectors")
    pool = written(spark, pools(v.select("g", "l", "base_failed")), "pools")
    fed = written(spark, _with(v.where(~F.col("base_failed")).select("g", *X), pool.select("g", "fed")).select(F.explode("fed").alias("g"), *X), "fed")
    best = written(spark, robust_estimates(spark, fed), "estimate")
    v = _with(v, pool.select("g", "own")).drop("g", "l").withColumnRenamed("own", "g")
    d = _distance(_with(v, best, "left")).withColumn("distance", F.col("d2") / CONSISTENCY)
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.coalesce(F.col("distance") <= CUTOFF, F.lit(False))).alias("kept"), "distance")
