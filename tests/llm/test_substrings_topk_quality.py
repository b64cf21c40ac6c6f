import hashlib
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from sieveline.llm import quality, substrings, topk


def brute_removed(rows, window):
    first = {}
    words = [(d, (t or "").encode().split()) for d, t, *_ in rows]
    for d, ws in words:
        if d is not None:
            for i in range(len(ws) - window + 1):
                k = tuple(ws[i : i + window])
                first[k] = min(first.get(k, d), d)
    out = []
    for d, ws in words:
        gone = set()
        if d is not None:
            for i in range(len(ws) - window + 1):
                if first[tuple(ws[i : i + window])] < d:
                    gone |= set(range(i, i + window))
        kept = b" ".join(w for i, w in enumerate(ws) if i not in gone)
        out.append((str(d), len(ws), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def told(df):
    return sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect())


def test_substrings_against_brute_force(spark, odd_docs, no_docs):
    _, wide, rows = odd_docs
    assert told(substrings.deduplicate(spark, wide)) == brute_removed(rows, 50)
    assert substrings.deduplicate(spark, no_docs).count() == 0


def test_substrings_with_a_crowded_sketch_lose_nothing(spark):
    r = random.Random(6)
    passages = [[r.choice("abcdefgh") for _ in range(r.randrange(5, 60))] for _ in range(12)]
    rows = []
    for i in range(120):
        ws = []
        for _ in range(r.randrange(6)):
            ws += r.choice(passages) if r.random() < 0.5 else [r.choice("abcdefghij") for _ in range(r.randrange(30))]
        rows.append((r.randrange(100), " ".join(ws)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    for width in (1 << 6, 1 << 16):
        assert told(substrings.deduplicate(spark, df, window=12, shingle=4, width=width)) == brute_removed(rows, 12)


def test_texts_in_pieces(spark, monkeypatch):
    r = random.Random(3)
    long = "  " + " \n".join(r.choice("abcdefgh") * r.randrange(1, 4) for _ in range(3000)) + " " + "x" * 9000 + " end"
    for text in (long, long.strip(), "x" * 50_000, ""):
        monkeypatch.setattr(substrings, "PIECE", 700)
        got = list(substrings.pieces(text.encode(), 12))
        ws = text.encode().split()
        windows = {(base + i, tuple(x.split()[i : i + 12])) for base, x in got for i in range(len(x.split()) - 11)}
        assert windows == {(i, tuple(ws[i : i + 12])) for i in range(len(ws) - 11)} and sum(len(x.split()) - 11 for _, x in got if len(x.split()) > 11) == max(0, len(ws) - 11)
    monkeypatch.undo()
    rows = [(2, long), (1, "start " + long[3000:9000]), (3, long[500:]), (4, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = told(substrings.deduplicate(spark, df, window=12, shingle=4))
    assert want == brute_removed(rows, 12)


def test_topk_against_brute_force(spark):
    r = np.random.default_rng(7)
    vecs = [(i, r.normal(0, 0.3, 6).tolist()) for i in range(900)]
    vecs += [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [float("nan")] * 6), (None, [1.0] * 6), (903, vecs[5][1]), (5, vecs[5][1]), (1000, [1e12] * 6), (1001, [3.0])]
    df = spark.createDataFrame(vecs, "vec_id bigint, embedding array<double>")
    whole = [(i, [int(np.floor(1024 * x)) for x in v] + [0] * (6 - len(v))) for i, v in vecs if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, a in whole:
        if q % 100 == 0:
            near = sorted((-max(1 - topk.LIMIT, min(topk.LIMIT - 1, sum(x * y for x, y in zip(a, b, strict=True)))), i) for i, b in whole if i != q)[:10]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(near)]
    got = topk.exact_topk(spark, df, 10)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert topk.exact_topk(spark, df.limit(0)).count() == 0


def test_the_layout_lets_blocks_be_passed_over(spark):
    r = np.random.default_rng(11)
    centres = np.sign(r.normal(size=(20, 16)))
    m = np.vstack([c + r.normal(0, 0.1, (60, 16)) for c in centres])[r.permutation(1200)]
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(m)], "vec_id bigint, embedding array<double>")
    rows = topk.quantized(df, "vec_id", "embedding", 1024)
    placed = topk.laid_out(spark, rows, 16).collect()
    ids, v, place = (np.array([x[c] for x in placed]) for c in ("vec_id", "v", "place"))
    assert sorted(ids) == list(range(1200))
    blocks = topk.blocks_of(ids, v, place)
    assert sum(len(b[0]) for b in blocks) == 1200
    top = topk.empty_top(12, 10)
    assert topk.pruned_topk(np.arange(0, 1200, 100), v[np.argsort(ids)][::100], blocks, top) < 0.5 * 12 * len(blocks)


def test_topk_in_batches_with_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(topk, "BATCH", 3)
    r = np.random.default_rng(12)
    df = spark.createDataFrame([(i, r.normal(size=4).tolist()) for i in range(1000)], "vec_id bigint, embedding array<double>")
    wide = df.selectExpr("*", "1 as place", "2 as v", "3 as score", "4 as query_id", "5 as rank", "6 as label")
    got = sorted(map(tuple, topk.exact_topk(spark, wide).collect()))
    monkeypatch.undo()
    assert got == sorted(map(tuple, topk.exact_topk(spark, df).collect())) and len(got) == 100


def test_blocks_are_passed_over():
    r = np.random.default_rng(8)
    blocks = [(np.arange(i * 50, i * 50 + 50), np.floor(r.normal(20 * (i == 3), 1, (50, 4)) * 100)) for i in range(20)]
    top = topk.empty_top(1, 5)
    assert topk.pruned_topk(np.array([-1]), np.full((1, 4), 100.0), blocks, top) < 20
    assert set(top[1][0]) <= set(range(150, 200))


def brute_base(t):
    t = t or ""
    ws = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
    n = len(ws)
    count = Counter(tuple(ws[i : i + 8]) for i in range(n - 7))
    covered = {j for i in range(n - 7) if count[tuple(ws[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return n, sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_statistics_and_verdicts(spark, odd_docs, no_docs):
    _, wide, rows = odd_docs
    got = quality.judge(spark, wide).collect()
    assert sorted((str(g["doc_id"]), *g[1:6]) for g in got) == sorted((str(d), *brute_base(t)) for d, t, *_ in rows)
    for g in got:
        assert g["base_failed"] == (g["n_words"] < 20 or 100 * g["n_repeat_words"] > 30 * g["n_words"])
        assert not (g["base_failed"] and g["kept"])
    assert quality.judge(spark, no_docs).count() == 0


def test_robust_estimates_reject_planted_outliers_only(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 9)))
    rows = [(i, " ".join(word() for _ in range(r.randrange(30, 300))).capitalize() + ".", "en" if i % 2 else None, "s", None) for i in range(400)]
    rows += [(1000 + i, " ".join(word() + "%%%" for _ in range(80)), "en" if i % 2 else None, "s", None) for i in range(80)]
    rows += [(2000 + i, " ".join(word().upper() + "!!" for _ in range(80)), "en" if i % 2 else None, "s", None) for i in range(40)]
    got = {g["doc_id"]: g["kept"] for g in quality.judge(spark, spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")).collect()}
    assert all(got[i] for i in range(400)) and not any(v for i, v in got.items() if i >= 1000)


def test_small_groups_are_judged_by_the_next_wider_pool(spark):
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 9)))
    clean = lambda: " ".join(word() for _ in range(r.randrange(30, 300))).capitalize() + "."
    junk = lambda: " ".join(word() + "%%%" for _ in range(80))
    # en: one large source and twelve small ones; fr and null: fewer rows than LEAST in the whole language
    groups = [("en", "large")] * 100 + [("en", f"s{i}") for i in range(12) for _ in range(8)] + [("fr", None)] * 10 + [(None, "x")] * 10
    rows = [(i, clean(), *g) for i, g in enumerate(groups)] + [(1000 + i, junk(), *g) for i, g in enumerate(dict.fromkeys(groups))]
    schema = "doc_id bigint, text string, lang string, source string"
    for some in (rows, [x for x in rows if x[2] is None]):
        got = quality.judge(spark, spark.createDataFrame(some, schema)).collect()
        assert {g["doc_id"]: g["kept"] for g in got} == {x[0]: x[0] < 1000 for x in some}
        assert all(g["distance"] is not None for g in got)


def brute_vector(t):
    import math

    import regex

    n, chars, symbols, _, repeats = brute_base(t)
    t = t or ""
    share = lambda k, usual: math.sqrt((k + usual * 150) / (chars + 150))
    x = [math.log((chars + 150) / (n + 30)), share(symbols, 0), math.sqrt(repeats / (n + 30)), share(len(regex.findall(r"\p{Lu}", t)), 0.02), share(len(regex.findall(r"[^\p{L}\p{N}#*$%&|<>\s]", t)), 0.02)]
    return [math.floor(v * 1000 + 0.5) for v in x]


def brute_mcd(groups):
    """group -> its rows; distance functions of the settled cores, from two starts, by the definition. All go on until all have settled."""
    floors = np.diag([float(v) ** 2 for v in quality.STATS.values()])
    of = lambda rows: (rows.mean(0), np.cov(rows.T, bias=True) + floors)
    now = {}
    for g, x in groups.items():
        q = np.percentile(x, [25, 50, 75], axis=0)
        now[g, 0], now[g, 1] = (q[1], np.diag(((q[2] - q[0]) / 1.349) ** 2) + floors), of(x)
    logdet = lambda c: np.linalg.slogdet(c)[1] / 2
    while True:
        new = {}
        for (g, start), (m, c) in now.items():
            x = groups[g]
            d2 = ((x - m) @ np.linalg.inv(c) * (x - m)).sum(1)
            k = np.minimum(quality.CLASSES, np.floor(np.log1p(d2) * 64)).astype(int)
            before = np.array([(k < i).sum() for i in k])
            new[g, start] = of(x[k <= k[before < np.ceil(len(x) * quality.CORE)].max()])
        moved = max(abs(logdet(new[s][1]) - logdet(now[s][1])) for s in now)
        now = new
        if moved < quality.SETTLED:
            break
    best = {g: min((now[g, 0], now[g, 1]), key=lambda f: logdet(f[1])) for g in groups}
    return {g: lambda v, m=m, c=c: (v - m) @ np.linalg.inv(c) @ (v - m) / quality.CONSISTENCY for g, (m, c) in best.items()}


def test_verdicts_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("lang in ('en', 'fr')").select("doc_id", "text", "lang", F.lit("s").alias("source"))
    rows = docs.orderBy("doc_id").limit(900).collect()
    got = {g["doc_id"]: g for g in quality.judge(spark, spark.createDataFrame(rows, docs.schema)).collect()}
    vectors = {r["doc_id"]: np.array(brute_vector(r["text"]), float) for r in rows}
    groups = {}
    for r in rows:
        if not got[r["doc_id"]]["base_failed"]:
            groups.setdefault(r["lang"], []).append(vectors[r["doc_id"]])
    assert len(groups) == 2 and min(map(len, groups.values())) >= quality.LEAST
    judge = brute_mcd({g: np.array(v) for g, v in groups.items()})
    for r in rows:
        d = r["doc_id"]
        distance = judge[r["lang"]](vectors[d])
        assert np.isclose(got[d]["distance"], distance, rtol=1e-6)
        assert got[d]["kept"] == (not got[d]["base_failed"] and distance <= quality.CUTOFF)
    assert 0 < sum(g["kept"] for g in got.values()) < len(got)


def test_estimates_against_numpy(spark):
    r = np.random.default_rng(10)
    x = np.vstack([r.multivariate_normal([500] * 5, np.diag([200.0**2] * 5) + 15000, 300), r.normal(5000, 30, (60, 5))]).round().astype(int)
    df = spark.createDataFrame([("g", *map(int, row)) for row in x], "g string, " + ", ".join(f"{c} bigint" for c in quality.X))
    e = quality.robust_estimates(spark, df).first()
    mean = np.array([e[m] for m in quality.MEANS])
    low = np.zeros((5, 5))
    for i, j in quality.PAIRS:
        low[i, j] = e[f"l{i}{j}"]
    d2 = lambda m, c: ((x - m) @ np.linalg.inv(c) * (x - m)).sum(1)
    core = d2(mean, low @ low.T) <= np.quantile(d2(mean, low @ low.T), 0.75)
    assert not core[300:].any()
    floors = np.diag([float(v) ** 2 for v in quality.STATS.values()])
    assert np.allclose(np.cov(x[core].T, bias=True) + floors, low @ low.T, rtol=0.15, atol=3000)
