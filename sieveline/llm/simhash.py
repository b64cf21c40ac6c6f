"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint bit is the majority of that bit over the hashes of a text's shingles. Fingerprints link at
`radius` or fewer differing bits. For radius r each bit position is given a nonzero vector of r + 1 bits, and
for each of the 2^(r+1) - 1 nonzero vectors v there is a table whose mask keeps the positions with an odd product with v. For
any r positions some v is orthogonal to all of them, so every pair within the radius collides in
at least one table: no link is lost.

Equal fingerprints are one node from the start, so exact copies cost nothing. In a table's bucket the
linked groups are found by a search that compares each reached fingerprint only with those not reached yet, and a
bucket gives a spanning forest, never all pairs. A bucket beyond LIMIT fingerprints is dealt into
buckets of a second covering over the positions that its mask left free; those hold at most
2^(free positions outside the second mask) (about 2^16) different fingerprints each, a fixed bound, and lose no link either.

Texts: null and empty texts have no words, fingerprint zero, and link like any other. Rows with a null id are
kept; they count for links but give no component id unless another row does. Repeated rows appear once each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.common import lean, written
from sieveline.llm.components import connected_components

BITS, LIMIT = 64, 8192


def fingerprint(text: str | None, shingle: int = 4) -> int:
    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and exactly the six ASCII spaces
    n = len(ws)
    if not n:
        return 0
    whole = b" ".join(ws)
    if n <= shingle:
        h = [xxhash.xxh64_intdigest(whole, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, ws), np.int64, n) + 1)
        digest = xxhash.xxh64_intdigest
        h = [digest(whole[a:b], 42) for a, b in zip([0, *ends[: n - shingle].tolist()], (ends[shingle - 1 :] - 1).tolist(), strict=True)]
    bits = np.unpackbits(np.array(h, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(bits.sum(0, dtype=np.int64) * 2 > len(h), bitorder="little").view("<u8")[0])


def masks(positions: list[int], radius: int) -> list[int]:
    """The covering masks over these bit positions, as unsigned integers."""
    n = 2 ** (radius + 1) - 1
    return [sum(1 << p for i, p in enumerate(positions) if ((1 + i % n) & v).bit_count() % 2) for v in range(1, n + 1)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def spanning(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges (first, other) that join the linked groups of different unsigned fingerprints."""
    out: list[tuple[int, int]] = []
    rest = fps
    while len(rest) > 1:
        first, rest = rest[0], rest[1:]
        todo = [first]
        while todo and len(rest):
            near = np.bitwise_count(rest ^ todo.pop()) <= radius
            if near.any():
                got = rest[near]
                out += [(int(first), int(x)) for x in got]
                todo += list(got)
                rest = rest[~near]
    return out


def _grouped(batches: Iterator[pa.RecordBatch], key_of, limit: int | None):
    """Groups of rows with equal keys in sorted input: (key columns of the group, fps, over). Groups of one row are passed over.

    Beyond `limit` rows a group comes in pieces of that size, each marked over.
    """
    held: list[np.ndarray] = []
    key, over = None, False
    for b in batches:
        cols = [c.to_numpy() for c in b.columns]
        keys = np.stack(key_of(*cols), 1)
        fps = cols[-1].view(np.uint64)
        if not len(fps):
            continue
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(fps)]])
        many = np.flatnonzero(ends - starts > 1)
        for g in sorted({0, len(starts) - 1, *many.tolist()}):
            a, z = starts[g], ends[g]
            k = tuple(keys[a].tolist())
            if k != key:
                if held and (over or sum(map(len, held)) > 1):
                    yield key, np.concatenate(held), over
                held, key, over = [], k, False
            held.append(fps[a:z])
            if limit and sum(map(len, held)) > limit:
                over = True
                yield key, np.concatenate(held), True
                held = []
    if held and (over or sum(map(len, held)) > 1):
        yield key, np.concatenate(held), over


def links(spark: SparkSession, fps: DataFrame, radius: int = 4, limit: int = LIMIT) -> DataFrame:
    """fps(fp bigint), different values -> edges (a, b): a forest that joins all fingerprints linked directly or through others."""
    first = masks(list(range(BITS)), radius)
    second = [masks([p for p in range(BITS) if not m >> p & 1], radius) for m in first]
    np_first = np.array(first, np.uint64)
    np_second = np.array([[m | s for s in row] for m, row in zip(first, second, strict=True)], np.uint64)
    schema = "t int, a bigint, b bigint"
    names = ["t", "a", "b"]

    def table(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
        c = list(zip(*rows, strict=True)) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int32()), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in c[1:])], names)

    def level_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list = []
        for (t, _), f, over in _grouped(batches, lambda t, fp: (t.astype(np.uint64), fp.view(np.uint64) & np_first[t]), limit):
            rows += [(int(t), int(x), int(x)) for x in f] if over else [(-1, a, b) for a, b in spanning(np.unique(f), radius)]
            if len(rows) > 50_000:
                yield table(rows)
                rows = []
        yield table(rows)

    def level_two(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, f, _ in _grouped(batches, lambda t, s, fp: (t.astype(np.uint64), s.astype(np.uint64), fp.view(np.uint64) & np_second[t, s]), None):
            yield table([(-1, a, b) for a, b in spanning(np.unique(f), radius)])

    spread = fps.select(F.explode(F.array([F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("k")) for i, m in enumerate(first)])).alias("x"), "fp").select("x.t", "x.k", "fp")
    found = written(spark, spread.repartition("t", "k").sortWithinPartitions("t", "k").select("t", "fp").mapInArrow(lean(level_one), schema), "links")
    edges = found.where("t < 0").select("a", "b")
    large = found.where("t >= 0").select("t", F.col("a").alias("fp"))
    if not large.isEmpty():
        keys = F.array([F.array([F.lit(signed(m | s)) for s in row]) for m, row in zip(first, second, strict=True)])
        deal = large.select("t", F.posexplode(keys[F.col("t")]).alias("s", "m"), "fp").select("t", "s", F.col("fp").bitwiseAND(F.col("m")).alias("k"), "fp")
        more = deal.repartition("t", "s", "k").sortWithinPartitions("t", "s", "k").select("t", "s", "fp").mapInArrow(lean(level_two), schema)
        edges = edges.unionByName(more.select("a", "b"))
    return edges


def near_duplicates(spark: SparkSession, docs: DataFrame, shingle: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the least doc_id reachable over links)."""
    return with_components(spark, _prints(spark, docs, shingle, id_col, text_col), radius)


def _prints(spark: SparkSession, docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, th, fp) of every row; th is a hash of the text."""

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = np.array([fingerprint(t.as_py(), shingle) for t in b.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(f)], ["doc_id", "th", "fp"])

    text = docs[text_col].cast("string")
    return written(spark, docs.select(docs[id_col].cast("bigint").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text")).mapInArrow(lean(prints), "doc_id bigint, th bigint, fp bigint"), "fingerprints")


def _labels(spark: SparkSession, nodes: DataFrame, radius: int) -> DataFrame:
    """nodes(fp) -> (fp, label) of those with a link, label the same throughout a component."""
    return connected_components(spark, links(spark, nodes.select("fp"), radius)).withColumnRenamed("node", "fp")


def with_components(spark: SparkSession, made: DataFrame, radius: int = 4) -> DataFrame:
    """(doc_id, fp) -> doc_id, fingerprint, component_id."""
    nodes = written(spark, made.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    linked = written(spark, _labels(spark, nodes, radius).join(nodes, "fp").select("fp", "label", "first"), "linked")
    least = linked.groupBy("label").agg(F.min("first").alias("least"))
    by_fp = nodes.join(linked.join(least, "label").select("fp", "least"), "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id"))
    return made.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(spark: SparkSession, docs: DataFrame, radius: int = 4) -> DataFrame:
    """The documents of which each group of near-duplicates keeps one: the one with the least doc_id, of rows that share it the one whose
    text has the least hash, and of rows equal in both any one. Rows that share a doc_id but are no near-duplicates are apart.

    The columns of documents, no others. Rows with a null doc_id are kept.
    """
    made = _prints(spark, docs, 4, "doc_id", "text")
    # one row a fingerprint before anything is joined, so that no group of copies is hot
    nodes = written(spark, made.groupBy("fp").agg(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "th"))).alias("first")), "nodes")
    group = nodes.join(_labels(spark, nodes, radius), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    keep = group.groupBy("label").agg(F.min("first").alias("k")).where("k is not null").select(F.col("k.doc_id").alias("keep_id"), F.col("k.th").alias("keep_th"))
    cols = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(cols))))
    id_at, text_at = (F.col(f"c{cols.index(c)}") for c in ("doc_id", "text"))
    plain = plain.withColumn("keep_id", id_at.cast("bigint")).withColumn("keep_th", F.xxhash64(text_at.cast("string")))
    named = plain.where("keep_id is not null").join(keep, ["keep_id", "keep_th"], "left_semi").dropDuplicates(["keep_id", "keep_th"])
    return named.unionByName(plain.where("keep_id is null")).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(cols)))
