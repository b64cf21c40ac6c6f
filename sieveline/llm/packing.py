"""Best-fit packing of tokenized documents by hierarchical residual packing.

Each partition packs its pieces best-fit, longest first. Full bins are done. Of the rest, each partition's
underfull bins go up a tree as items: groups of FAN partitions repeat best fit over them until one group is
left. After best fit at most one bin of a group is half full or less, and two fuller ones never share a sequence. So a merge
of FAN groups moves FAN bins at most, and of hosts with the same free room it takes FAN at most: a group hands up
that many for each level above it, of every free room there is. The others stay behind, as no merge could come to them:
sequences are as many as if every bin went up. So every task's input is bounded, by the capacity and the levels.

Documents: null text counts as empty, an empty text is its end id alone. Documents longer than
`capacity` are cut into pieces of that length, of which the first may be shorter. Repeated rows are packed each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.common import lean, written
from sieveline.llm.tokens import ids_of, paths

CAPACITY, END = 2048, 0
#: Pieces a leaf partition packs (about), groups merged at once.
LEAF, FAN = 50_000, 16
#: Mapping rows that may be broadcast.
SMALL = 200_000


def pieces(docs: DataFrame, where: tuple[str, str, str] | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, little-endian unsigned 32-bit) of all documents."""
    where = where or paths()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    end = np.array([END], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = ids_of(where)
        for b in batches:
            rows: list[tuple] = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = ids.of(t.as_py() or "") + end
                n = len(raw) // 4
                at, k = 0, 0
                to = n if n <= capacity else n % capacity or capacity
                while at < n:
                    part = raw[4 * at : 4 * to]
                    rows.append((d, k, at, to - at, zlib.crc32(part), *([part] * with_ids)))
                    at, to, k = to, min(n, to + capacity), k + 1
            c = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, kinds, strict=False)], names)
        ids.forget()  # the worker lives on, through stages that need no chunks

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(cut), schema)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each item, taken in the order given, and the load of each bin: the fullest bin with room takes the item."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, loads = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    some = 0  # bit r: a bin with room r exists
    for i, n in enumerate(lengths.tolist()):
        fits = some >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                some ^= 1 << r
        else:
            r, b = capacity, len(loads)
            loads.append(0)
        bins[i], offsets[i] = b, loads[b]
        loads[b] += n
        r -= n
        if r:
            if not room[r]:
                some |= 1 << r
            room[r].append(b)
    return bins, offsets, np.array(loads, np.int64)


def handed_up(loads: np.ndarray, capacity: int, levels: int = 1) -> np.ndarray:
    """Which bins go up the tree with so many levels above: those half full or less, and of the others with room FAN a level for each load."""
    up = loads * 2 <= capacity
    hosts = np.flatnonzero(~up & (loads < capacity))
    hosts = hosts[np.argsort(loads[hosts], kind="stable")]
    nth = np.arange(len(hosts)) - np.searchsorted(loads[hosts], loads[hosts])
    up[hosts[nth < FAN * levels]] = True
    return up


def _leaf(capacity: int, levels: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not got:
            return
        t = pa.Table.from_batches(got).sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets, loads = best_fit(t["length"].to_numpy(), capacity)
        base = TaskContext.get().partitionId() << 32
        up = handed_up(loads, capacity, levels)
        out = t.append_column("bin", pa.array(bins + base)).append_column("offset", pa.array(offsets)).append_column("load", pa.array(loads[bins])).append_column("up", pa.array(up[bins]))
        yield from out.combine_chunks().to_batches()

    return pack


def _merge(capacity: int, levels: int):
    def merge(t: pa.Table) -> pa.Table:
        t = t.sort_by([("load", "descending"), ("bin", "ascending")])
        ids = t["bin"].to_numpy()
        bins, offsets, loads = best_fit(t["load"].to_numpy(), capacity)
        heads = np.empty(len(loads), np.int64)
        heads[bins[offsets == 0]] = ids[offsets == 0]
        return pa.table({"bin": pa.array(ids), "into": pa.array(heads[bins]), "moved": pa.array(offsets), "load": pa.array(loads[bins]), "up": pa.array(handed_up(loads, capacity, levels)[bins])})

    return merge


def pack(spark: SparkSession, made: DataFrame, capacity: int = CAPACITY, leaf: int = LEAF) -> DataFrame:
    """pieces(doc_id, piece, start, length, ids_crc32) as written -> the same with sequence_id and offset."""
    full = made.where(F.col("length") == capacity).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    part = made.where(F.col("length") < capacity)
    leaves = max(1, -(-part.count() // leaf))
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, bin bigint, offset bigint, load bigint, up boolean"
    # dealt out in turn, so that no key can be hot
    placed = written(spark, part.select("doc_id", "piece", "start", "length", "ids_crc32").repartition(leaves).mapInArrow(lean(_leaf(capacity, _levels(leaves, 1))), schema), "leaves")
    bins = placed.where("up and offset = 0").select("bin", "load", F.shiftright("bin", 32).alias("group"))
    groups, moves = leaves, None
    while groups > 1:
        groups = -(-groups // FAN)
        bins = bins.withColumn("group", F.floor(F.col("group") / FAN).cast("bigint"))
        turn = written(spark, bins.groupBy("group").applyInArrow(_merge(capacity, _levels(groups, 1)), "bin bigint, into bigint, moved bigint, load bigint, up boolean").withColumn("group", F.lit(None).cast("bigint")), "merge")
        step = turn.where("bin <> into").select("bin", "into", "moved")
        if moves is None:
            moves = step
        else:  # what had been moved moves on with its new bin
            on = step.select(F.col("bin").alias("b"), F.col("into").alias("i"), F.col("moved").alias("m"))
            moves = moves.join(on, moves["into"] == on["b"], "left").select("bin", F.coalesce("i", "into").alias("into"), (F.col("moved") + F.coalesce("m", F.lit(0))).alias("moved")).unionByName(step)
        moves = written(spark, moves, "moves")
        bins = turn.where("up and bin = into").select("bin", "load", F.floor(F.shiftright("bin", 32) / F.lit(FAN ** max(1, round(_levels(leaves, groups))))).cast("bigint").alias("group"))
    if moves is None:
        return placed.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset").unionByName(full)
    if moves.count() <= SMALL:
        moves = F.broadcast(moves)
    got = placed.join(moves, "bin", "left")
    got = got.select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("into", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("moved", F.lit(0))).alias("offset"))
    return got.unionByName(full)


def _levels(leaves: int, groups: int) -> int:
    """Rounds of merging that lead from so many leaves to so many groups."""
    n = 0
    while leaves > groups:
        leaves, n = -(-leaves // FAN), n + 1
    return n


def pack_documents(spark: SparkSession, docs: DataFrame, where: tuple[str, str, str] | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of each document, with the sequence and the offset where it lies."""
    made = written(spark, pieces(docs, where, capacity), "pieces")
    return pack(spark, made, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
