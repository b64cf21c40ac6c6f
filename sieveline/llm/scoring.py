"""Language-model scores: a counted unigram base and a causal self-attention model on subword ids.

Texts are read as words with A-Z in lower case and an end. Word counts over all training documents give the base score; the
words with the highest counts (at most HOT, of HOT_BYTES at most) go to every task, the occurrences of all others are joined by word.
Subword counts come from the word counts, since a word's subwords do not depend on its neighbours. Each text is read once into subword ids,
two bytes each, which are written for training and scoring. The attention model is trained by all partitions on all training documents, each in one of ROUNDS rounds by a hash: in a round each partition trains
from the common state, and states are averaged up a tree by the predictions they saw. Windows overlap so that
each subword is scored once with context before it.

Null and empty texts are the end alone. A null doc_id counts as the text ''. Without training documents counts are zero, base scores follow the
formula as far as it has a value (0 training tokens and no words: N + 0.1), and the model is uniform. Repeated rows are each scored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm import attention
from sieveline.llm.common import dropped, one_core_each, written
from sieveline.llm.tokens import Bounded, ids_of, paths
from sieveline.llm.toxicity import remainder

HOT, HOT_BYTES, KEYS, ROUNDS = 300_000, 64, 500_000, 2
#: Subwords with an input of their own, classes of those by neighbours, classes of the rest by count, buckets of neighbours.
OWN, CLASSES, RARE, BUCKETS = 2048, 56, 8, 64
#: Partitions whose states one task averages.
FAN = 64
#: Ids learnt or scored at once.
CHUNK = 200_000
#: Bytes of text cut into words at once; a longer text is cut alone.
LOT = 4 << 20
#: White space other than a space.
OTHER_SPACE = re.compile(r"[^\S ]")
END, SIZE = 50256, 50257


def lower_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def lots(b: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """The rows of b in runs of about LOT bytes of their column `text`."""
    lot = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy().astype(np.int64)) // LOT
    cuts = [0, *(np.flatnonzero(np.diff(lot)) + 1).tolist(), len(lot)]
    for a, z in zip(cuts[:-1], cuts[1:], strict=True):
        if a < z:
            yield b.slice(a, z - a)


def told_apart(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different words (binary) of some texts, which of them each word is, and where each text's words begin and the last one's end."""
    cut = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    full = pc.not_equal(pc.binary_length(cut.values), 0)  # white space at an end leaves an empty one there
    begins = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])[cut.offsets.to_numpy()]
    coded = cut.values.filter(full).dictionary_encode()
    return coded.dictionary.cast(pa.binary()), coded.indices.to_numpy(), begins


class Words(Bounded):
    """word -> (bytes of its ids, read after a space; what `known` has for it)."""

    def __init__(self, where: tuple[str, str, str], known: dict[bytes, float] | None = None):
        super().__init__()
        self.quick, self.spaced, self.known = ids_of(where).quick, ids_of(where).spaced, known or {}

    def __missing__(self, word: bytes) -> tuple[bytes, float | None]:
        ids = self.quick(" " + word.decode("utf-8", "replace"), set())
        return self.keep(word, (ids, self.known.get(word)), len(ids))

    def ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where those of each word begin, how many they are): words are tokenized all at once, as no id reaches over a space.

        Those with other white space in them are tokenized each, after the rest."""
        apart: list[int] = []
        plain = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), b" ")[0].as_py().decode("utf-8", "replace")
        if OTHER_SPACE.search(plain):
            each = words.to_pylist()
            apart = [i for i, w in enumerate(each) if OTHER_SPACE.search(w.decode("utf-8", "replace"))]
            plain = b" ".join(np.delete(np.array(each, object), apart)).decode("utf-8", "replace")
        together = np.delete(np.arange(len(words)), apart)
        ids = np.frombuffer(self.quick(" " + plain, set()) if len(together) else b"", "<u4")
        first, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        first[together] = np.flatnonzero(self.spaced[ids])
        size[together] = np.diff(first[together], append=len(ids))
        if apart:
            raw = [self[each[i]][0] for i in apart]
            size[apart] = [len(x) // 4 for x in raw]
            first[apart] = len(ids) + np.cumsum(size[apart]) - size[apart]
            ids = np.concatenate([ids, np.frombuffer(b"".join(raw), "<u4")])
        return ids, first, size


def gathered(values: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of values one after another, each by its first place and its size; where each begins there, and the end."""
    upto = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat((first - upto[:-1]).astype(np.int32 if max(upto[-1], len(values)) < 2**31 else np.int64), size)
    at += np.arange(upto[-1], dtype=at.dtype)
    return np.take(values, at), upto


def as_binary(values: np.ndarray, begins: np.ndarray) -> pa.Array:
    """Binary values from an array that holds them all, by where each begins and the end."""
    return pa.Array.from_buffers(pa.large_binary(), len(begins) - 1, [None, pa.py_buffer((begins * values.itemsize).astype(np.int64)), pa.py_buffer(values)]).cast(pa.binary())


def flat_ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a column of them in four bytes each, and how many each row has."""
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), "<u4"), np.fromiter((len(x) // 4 for x in raw), np.int64, len(raw))


def read_words(texts: pa.Array, of: Words, known: tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, pa.Array]:
    """Of each text: its number of words, of those known (words, values, all ids, how many each has) and the sum of their values, the other words with their numbers, and its stream."""
    words, which, begins = told_apart(texts)
    n, k, end = np.diff(begins), len(texts), len(words)
    doc = np.repeat(np.arange(k), n)
    place = pc.fill_null(pc.index_in(words, known[0]), -1).to_numpy()
    logs, found = np.append(known[1], 0.0)[place], place >= 0
    hit = found[which]
    # each text's other words: pairs of text and word, as often as they occur
    pairs, times = np.unique(doc[~hit] * max(1, end) + which[~hit], return_counts=True)
    rare = pa.StructArray.from_arrays([words.take(pa.array(pairs % max(1, end))), pa.array(times, pa.int64())], ["word", "k"])
    rare = pa.ListArray.from_arrays(pa.array(np.searchsorted(pairs, np.arange(k + 1) * max(1, end)), pa.int32()), rare)
    # each text's ids: those of its words between two ends
    new = np.flatnonzero(~found)
    held, sizes = known[2], np.append(known[3], 0)
    ids, first, size = of.ids(words.take(pa.array(new)))
    begin, long = (np.cumsum(sizes) - sizes)[place], sizes[place]
    begin[new], long[new] = first + len(held), size
    order = np.full(len(which) + 2 * k, end, np.int32)
    order[np.arange(len(which)) + 2 * doc + 1] = which
    values = np.concatenate([held, ids, np.array([END], "<u4")]).astype("<u2")
    streams, upto = gathered(values, np.append(begin, len(values) - 1)[order], np.append(long, 1)[order])
    return n, np.bincount(doc, hit, k).astype(np.int64), np.bincount(doc, logs[which], k), rare, as_binary(streams, upto[begins + 2 * np.arange(k + 1)])


def stream(ids: list[bytes]) -> bytes:
    """END, the ids of the words, END, in two bytes each."""
    end = np.array([END], "<u4").tobytes()
    return np.frombuffer(b"".join([end, *ids, end]), "<u4").astype("<u2").tobytes()


def ids_in(column: pa.Array) -> Iterator[list[np.ndarray]]:
    """The id sequences of a column of streams, about CHUNK ids at a time."""
    some, size = [], 0
    for x in column:
        some.append(np.frombuffer(x.as_buffer(), "<u2").astype(np.int32))
        size += len(some[-1])
        if size > CHUNK:
            yield some
            some, size = [], 0
    if some:
        yield some


def word_counts(docs: DataFrame) -> DataFrame:
    """word (binary), n over these documents; counted in each partition before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def summed() -> pa.Table:
            return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"}).select(["word", "n"])

        for b in batches:
            for lot in lots(b, 0):
                words, which, _ = told_apart(lot.column(0))
                held.append(pa.table({"word": words, "n": pa.array(np.bincount(which, minlength=len(words)), pa.int64())}))
                if sum(map(len, held)) > 2 * KEYS:
                    held = [summed()]
                    if len(held[0]) > KEYS:
                        yield from held.pop().to_batches()
        if held:
            yield from summed().to_batches()

    return docs.select(F.col("text").cast("string")).mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def spelt_words(counts: DataFrame, where: tuple[str, str, str]) -> DataFrame:
    """word, n, ids of (word, n) rows."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Words(where)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, as_binary(*gathered(*of.ids(b.column(0))))], ["word", "n", "ids"])

    return counts.select("word", "n").mapInArrow(spell, "word binary, n bigint, ids binary")


def _sum_by_key(rows: DataFrame, size: int) -> np.ndarray:
    """(key, n) rows with keys below size -> their sums."""
    got = rows.groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[got["key"].to_numpy()] = got["n"].to_numpy()
    return out


def classes_of(counts: np.ndarray, near: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Class of each id: those with an input of their own by their neighbours (k-means on roots of shares), the rest by count."""
    cls = np.zeros(SIZE, np.int64)
    f = np.sqrt(near / np.maximum(1, near.sum(1, keepdims=True)))
    w = counts[own].astype(float) + 1
    centre = f[np.linspace(0, len(own) - 1, CLASSES).astype(int)]
    for _ in range(12):
        at = ((f**2).sum(1)[:, None] - 2 * f @ centre.T + (centre**2).sum(1)).argmin(1)
        total = np.bincount(at, w, CLASSES)
        for c in np.flatnonzero(total):
            centre[c] = (f[at == c] * w[at == c, None]).sum(0) / total[c]
    # neighbours in one group: classes in the order of their centres along the line of most spread
    spread = np.linalg.svd(centre - centre.mean(0), full_matrices=False)[2][0]
    rank = np.empty(CLASSES, np.int64)
    rank[np.argsort(centre @ spread, kind="stable")] = np.arange(CLASSES)
    rest = np.setdiff1d(np.arange(SIZE), own)
    order = rest[np.argsort(-counts[rest], kind="stable")]
    mass = np.cumsum(counts[order] + 0.1)
    cls[order] = CLASSES + np.minimum(RARE - 1, (mass / mass[-1] * RARE).astype(int))
    cls[own] = rank[at]
    return cls


def average(spark: SparkSession, states: DataFrame, p: dict) -> tuple[dict, int]:
    """The mean of (part, seen, one binary a parameter) rows by what they saw, summed up a tree of FAN to one; the predictions they saw."""
    schema, names = states.schema, list(p)

    def add(t: pa.Table) -> pa.Table:
        seen = t["seen"].to_pylist()
        total = [sum(n * np.frombuffer(x.as_py(), "<f4").astype(float) for n, x in zip(seen, t[k], strict=True)) / max(1, sum(seen)) for k in names]
        return pa.table([t["part"][:1], pa.array([sum(seen)]), *(pa.array([x.astype("<f4").tobytes()]) for x in total)], ["part", "seen", *names])

    n = states.count()
    while n > 1:
        up = written(spark, states.withColumn("part", F.floor(F.col("part") / FAN).cast("bigint")).groupBy("part").applyInArrow(add, schema), "states")
        dropped(spark, states)
        states, n = up, up.count()
    rows = states.collect()  # one row of a fixed size, or none
    dropped(spark, states)
    if not rows:
        return p, 0
    return {k: np.frombuffer(rows[0][k], "<f4").reshape(v.shape) for k, v in p.items()}, rows[0]["seen"]


def fit(spark: SparkSession, docs: DataFrame, counts: DataFrame, n_docs: int, where: tuple[str, str, str]) -> dict:
    """The attention model from (word, n) counts and the training documents' streams (row, ids); seen is the number of predictions it learnt from."""
    sc = spark.sparkContext

    spelt = written(spark, spelt_words(counts, where).select("ids", "n"), "spelt")

    def add(total: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["key", "n"])

    def flat(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, lengths = flat_ids(b.column(0))
        return ids.astype(np.int64), np.repeat(np.arange(len(lengths)), lengths), b.column(1).to_numpy()

    def singles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE, np.int64)
        for b in batches:
            ids, row, n = flat(b)
            np.add.at(total, ids, n[row])
        yield add(total)

    subwords = _sum_by_key(spelt.mapInArrow(singles, "key bigint, n bigint"), SIZE)
    subwords[END] += n_docs
    own = np.sort(np.argsort(-subwords, kind="stable")[:OWN])
    place = np.full(SIZE, -1, np.int64)
    place[own] = np.arange(OWN)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((OWN, 2 * BUCKETS + 2), np.int64)
        for b in batches:
            ids, row, n = flat(b)
            same = np.concatenate([[False], row[1:] == row[:-1]]) if len(row) else np.zeros(0, bool)
            bucket = np.where(place[ids] >= 0, place[ids] * 40503 % BUCKETS, ids % BUCKETS)
            before = np.where(same, np.concatenate([[0], bucket[:-1]]), BUCKETS)[: len(ids)]
            after = np.where(np.concatenate([same[1:], [False]]), np.concatenate([bucket[1:], [0]]), BUCKETS)[: len(ids)]
            mine = place[ids] >= 0
            np.add.at(total, (place[ids][mine], before[mine]), n[row[mine]])
            np.add.at(total, (place[ids][mine], after[mine] + BUCKETS + 1), n[row[mine]])
        yield add(total.reshape(-1))

    near = _sum_by_key(spelt.mapInArrow(pairs, "key bigint, n bigint"), OWN * (2 * BUCKETS + 2)).reshape(OWN, -1)
    dropped(spark, spelt)
    cls = classes_of(subwords, near, own)
    share = np.bincount(cls, subwords + 0.1, CLASSES + RARE)
    within = np.log((subwords + 0.1) / share[cls]).astype(np.float32)
    # ids without an input of their own share that of their class
    inputs = np.where(place >= 0, place, OWN + cls).astype(np.int32)
    p = attention.new_parameters(OWN + CLASSES + RARE, np.maximum(share, 1e-9) / share.sum())
    learnt = 0
    for turn in range(ROUNDS):
        sent = sc.broadcast((p, inputs, cls))

        def learn(batches: Iterator[pa.RecordBatch], sent=sent, turn=turn) -> Iterator[pa.RecordBatch]:
            one_core_each()
            start, inputs, cls = sent.value
            trainer = attention.Trainer(start, seed=turn)
            for b in batches:
                for some in ids_in(b.column(0)):
                    trainer.learn(some, inputs, cls)
            if trainer.seen:
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([trainer.seen]), *(pa.array([v.astype("<f4").tobytes()]) for v in trainer.p.values())], ["part", "seen", *trainer.p])

        schema = "part bigint, seen bigint, " + ", ".join(f"{k} binary" for k in p)
        some = docs.where(F.pmod(F.xxhash64(F.lit("lm"), "row"), F.lit(ROUNDS)) == turn).select("ids")
        p, seen = average(spark, written(spark, some.mapInArrow(learn, schema), "states"), p)
        learnt += seen
        sent.destroy()
    return {"p": p, "inputs": inputs, "classes": cls, "within": within, "seen": learnt}


def score_documents(spark: SparkSession, docs: DataFrame, where: tuple[str, str, str] | None = None, hot: int = HOT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of documents."""
    where = where or paths()
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("held_out", remainder(F.col("doc_id"), 10) == 0)
    learnt = d.where(~F.col("held_out"))
    counts = written(spark, word_counts(learnt), "words")
    n_docs = learnt.count()
    total, distinct = counts.agg(F.sum("n"), F.count("*")).first()
    total, distinct = int(total or 0) + n_docs, distinct + (n_docs > 0)
    # the least count such that at most `hot` words of HOT_BYTES or less have it or more, to a sixteenth of an octave
    short = F.octet_length("word") <= HOT_BYTES
    least, held = None, 0
    for r in counts.where(short).groupBy(F.floor(F.log2("n") * 16).alias("c")).agg(F.count("*").alias("k"), F.min("n").alias("n")).orderBy(F.desc("c")).collect():  # some 16 x 63 rows at most
        held += r["k"]
        if held > hot:
            break
        least = r["n"]
    is_hot = short & (F.col("n") >= F.lit(least)) if least is not None else F.lit(False)
    top = spelt_words(counts.where(is_hot), where).toArrow()
    known = (pa.array(top["word"].to_pylist(), pa.binary()), np.log10(top["n"].to_numpy() + 0.1), *flat_ids(top["ids"]))
    sent = spark.sparkContext.broadcast((known, n_docs))
    del known, top

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ends = sent.value
        of, of_end = Words(where), float(np.log10(ends + 0.1))
        for b in batches:
            for lot in lots(b, 2):
                n, hit, logs, rare, ids = read_words(lot.column(2), of, known)
                yield pa.RecordBatch.from_arrays([lot.column(0), lot.column(1), pa.array(n + 1, pa.int64()), pa.array(hit + (ends > 0), pa.int64()), pa.array(logs + of_end), rare, ids], ["doc_id", "held_out", "n_tokens", "hit", "logs", "rare", "ids"])

    made = d.select("doc_id", "held_out", "text").mapInArrow(read, "doc_id bigint, held_out boolean, n_tokens bigint, hit bigint, logs double, rare array<struct<word:binary,k:bigint>>, ids binary")
    made = written(spark, made.withColumn("row", F.monotonically_increasing_id()), "streams")
    sent.destroy()
    model = spark.sparkContext.broadcast(fit(spark, made.where(~F.col("held_out")).select("row", "ids"), counts, n_docs, where))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_core_each()
        m = model.value
        tables = attention.make_tables(m["p"])
        for b in batches:
            out = [attention.score(m["p"], some, m["inputs"], m["classes"], m["within"], tables=tables) for some in ids_in(b.column(5))]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(np.concatenate([np.zeros(0), *out]) / np.log(10))], ["row", "doc_id", "held_out", "n_tokens", "base", "score"])

    # the other words of each document, as often as they occur there, meet their counts
    left = made.select("row", F.inline("rare"))
    met = left.join(counts.where(~is_hot), "word", "left")
    met = met.groupBy("row").agg(F.sum(F.when(F.col("n").isNotNull(), F.col("k")).otherwise(0)).alias("more"), F.sum(F.col("k") * F.log10(F.coalesce("n", F.lit(0)) + 0.1)).alias("more_logs"))
    norm = float(np.log10(total + 0.1 * (distinct + 1)))
    scored = made.select("row", "doc_id", "held_out", "n_tokens", F.struct("hit", "logs").alias("base"), "ids").mapInArrow(score, "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, base struct<hit:bigint,logs:double>, score double")
    out = scored.join(met, "row", "left")
    return out.select("doc_id", "held_out", "n_tokens", (F.col("base.hit") + F.coalesce("more", F.lit(0))).cast("bigint").alias("n_known"), F.lit(total).cast("bigint").alias("train_tokens"), (F.col("base.logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * norm).alias("base_score"), "score")
