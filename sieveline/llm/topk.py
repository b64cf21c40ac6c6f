"""Exact top-k inner-product search by block-at-a-time pruning.

Rows are laid out once in blocks of like vectors (of the nearest of CENTRES centres, fitted on a bounded sample by a hash of the id; every row is
indexed) with a forward index (their integer matrix) and, per dimension ("term"), the largest and smallest value in the block. For one query the bound of a
block is the sum over terms of the larger of query x maximum and query x minimum. A task orders its
blocks by that bound, scores them through the forward index, and stops for a query as
soon as no bound left reaches its k-th score, so results are exact however the blocks lie. Vectors without any grouping, such as
independent random ones in many dimensions, give bounds far above every score, and all blocks are scored.

Queries come in batches of a stated size (BATCH); one batch at a time is broadcast (BATCH x dimensions x 8
bytes at most) and run against all blocks, and each task hands on at most k rows a query.

Vectors that are null, or hold a null or a non-finite component, take no part; neither do rows
without an id. Vectors of unlike length are compared as if the shorter one ended in zeros. A row
with the query's own id is never its candidate. Repeated rows stay separate candidates. A score beyond 64 bits
is held at the limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sieveline.llm.common import dropped, one_core_each, written

#: Queries broadcast at once, rows in a block.
BATCH, BLOCK = 8192, 512
#: Centres that the layout follows, and rows (about) that they are fitted on.
CENTRES, SAMPLE = 64, 4096
LIMIT = 2**63 - 1


def quantized(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    v = F.col(vec_col).cast("array<double>")
    whole = F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(F.coalesce(whole, F.lit(False))).select(F.col(id_col).cast("bigint").alias("vec_id"), F.transform(v, lambda x: F.floor(x * scale).cast("double")).alias("v"))


def matrix(rows: list, dims: int) -> np.ndarray:
    m = np.zeros((len(rows), dims))
    for i, r in enumerate(rows):
        m[i, : min(len(r), dims)] = r[:dims]
    return m


def products(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """q @ m.T as int64, exact: in doubles while every partial sum is below 2^53, else in whole numbers."""
    if not q.size or not m.size or np.abs(q).max(initial=0) * np.abs(m).max(initial=0) * q.shape[1] < 2**53:
        return (q @ m.T).astype(np.int64)
    whole = [[int(x) for x in r] for r in q], [[int(x) for x in r] for r in m]
    return np.array([[max(1 - LIMIT, min(LIMIT - 1, sum(a * b for a, b in zip(r, s, strict=True)))) for s in whole[1]] for r in whole[0]], dtype=np.int64).reshape(len(q), len(m))


def empty_top(n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    return np.full((n, k), -LIMIT), np.full((n, k), LIMIT)


def pruned_topk(qids: np.ndarray, q: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray]], top: tuple[np.ndarray, np.ndarray]) -> int:
    """Take the rows of these blocks into top, the scores and ids of each query's best rows so far; returns how many (query, block) pairs were scored."""
    if not blocks or not len(q):
        return 0
    k, scored = top[0].shape[1], 0
    bound = np.stack([np.maximum(q, 0) @ m.max(0) + np.minimum(q, 0) @ m.min(0) for _, m in blocks], 1)
    bound += np.abs(bound) * 1e-9 + 1  # beyond any rounding
    order = np.argsort(-bound, axis=1, kind="stable")
    for turn in range(len(blocks)):
        now = order[:, turn]
        live = np.flatnonzero(np.take_along_axis(bound, now[:, None], 1)[:, 0] >= top[0][:, -1])
        if not len(live):
            break
        for b in np.unique(now[live]):
            at = live[now[live] == b]
            ids, m = blocks[b]
            score = products(q[at], m)
            score[qids[at][:, None] == ids[None, :]] = -LIMIT
            top[0][at], top[1][at] = _merge(top[0][at], top[1][at], score, ids, k)
            scored += len(at)
    return scored


def _merge(s0: np.ndarray, i0: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if score.shape[1] > 4 * k:  # all that reach the k-th largest score, ties included, then their exact order
        kth = -np.partition(-score, k - 1, axis=1)[:, k - 1]
        keep = score >= kth[:, None]
        width = int(keep.sum(1).max())
        part = np.argsort(~keep, axis=1, kind="stable")[:, :width]
        score, ids = np.take_along_axis(score, part, 1), ids[part]
    s, i = np.concatenate([s0, score], 1), np.concatenate([i0, np.broadcast_to(ids, score.shape)], 1)
    order = np.lexsort((i, -s), axis=1)[:, :k]
    return np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


def nearest(m: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2 * m @ centres.T).argmin(1)


def centres_of(rows: DataFrame, dims: int) -> np.ndarray:
    """Centres of some rows, by a few rounds of k-means; they decide the layout alone, never a result."""
    n = rows.count()
    some = rows.where(F.pmod(F.xxhash64(F.lit("layout"), "vec_id"), F.lit(1 << 30)) < int(min(1.0, SAMPLE / max(1, n)) * (1 << 30))).orderBy("vec_id").limit(2 * SAMPLE).collect()
    m = matrix([r["v"] for r in some], dims)
    centres = m[np.linspace(0, len(m) - 1, min(CENTRES, len(m))).astype(int)]
    for _ in range(6 if len(m) else 0):
        at = nearest(m, centres)
        for c in np.unique(at):
            centres[c] = m[at == c].mean(0)
    return centres


def blocks_of(ids: np.ndarray, m: np.ndarray, place: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Blocks of up to BLOCK neighbouring rows of one centre."""
    cuts = [0, *(np.flatnonzero(place[1:] != place[:-1]) + 1).tolist(), len(ids)]
    return [(ids[i : min(i + BLOCK, z)], m[i : min(i + BLOCK, z)]) for a, z in zip(cuts[:-1], cuts[1:], strict=True) for i in range(a, z, BLOCK)]


def laid_out(spark: SparkSession, rows: DataFrame, dims: int) -> DataFrame:
    """(vec_id, v, place) written in ranges of centre and id."""
    sent = spark.sparkContext.broadcast(centres_of(rows, dims))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_core_each()
        for b in batches:
            at = nearest(matrix(b.column(1).to_pylist(), dims), sent.value) if len(sent.value) else np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at.astype(np.int32))], ["vec_id", "v", "place"])

    placed = rows.mapInArrow(assign, "vec_id bigint, v array<double>, place int").repartitionByRange("place", "vec_id").sortWithinPartitions("place", "vec_id")
    return written(spark, placed, "blocks")


def exact_topk(spark: SparkSession, vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row whose id is divisible by `every`."""
    rows = written(spark, quantized(vectors, id_col, vec_col, scale), "vectors")
    dims = rows.agg(F.max(F.size("v"))).first()[0] or 0
    placed = laid_out(spark, rows, dims)
    queries = placed.where(F.col("vec_id") % every == 0).select("vec_id", "v")
    batches = max(1, -(-queries.count() // BATCH))
    parts = []
    for i in range(batches):
        some = queries if batches == 1 else queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(batches)) == i)
        got = some.orderBy("vec_id").collect()  # about BATCH rows
        sent = spark.sparkContext.broadcast((np.array([r[0] for r in got], np.int64), matrix([r[1] for r in got], dims)))

        def search(it: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            one_core_each()
            qids, q = sent.value
            top = empty_top(len(q), k)
            for b in it:  # an Arrow batch is bounded; its blocks are ordered together, against what went before
                pruned_topk(qids, q, blocks_of(b.column(0).to_numpy(), matrix(b.column(1).to_pylist(), dims), b.column(2).to_numpy()), top)
            row, col = np.nonzero(top[0] > -LIMIT)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (row, qids[row], top[1][row, col], top[0][row, col])], ["query_row", "query_id", "vec_id", "score"])

        found = placed.mapInArrow(search, "query_row bigint, query_id bigint, vec_id bigint, score bigint")
        w = Window.partitionBy("query_row", "query_id").orderBy(F.desc("score"), "vec_id")
        best = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        parts.append(written(spark, best, "top"))
        sent.destroy()
    dropped(spark, placed)
    dropped(spark, rows)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
