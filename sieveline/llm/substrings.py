"""Substring deduplication of word windows with a count-min prefilter.

A window is `window` consecutive words of one document; a word goes if a window that covers it
also starts in a document with a smaller id. Of the shingles of SHINGLE words in a window the least by hash is its anchor, so equal
windows have equal anchors and about one window in twenty brings a new one.

Pass one: each partition counts the anchors of its documents in a count-min sketch; merged, the
sketch never estimates an anchor, and so a window, below its true count. Pass two: only windows whose anchor is estimated
to occur twice are grouped exactly, so none is lost. Windows next to each other with one anchor travel as one
segment: equal segments are grouped whole, and only anchors with unlike segments are compared window by
window. Windows are the same if both their anchors and the first 80 bits of the XXH128 of their words are; segments likewise.

The sketch has about four cells an anchor up to MOST_CELLS a row; beyond that more windows pass to the exact grouping, which
gives the same result. A bitmap of its cells is all that the driver sees. Long texts are read in pieces of about PIECE bytes that
overlap by a window, and words beyond LONG bytes by their digest, so that memory stays a small multiple of the text.

Null and empty texts have no words. Rows with a null doc_id neither lose words nor make others lose any. Rows that
repeat a doc_id are judged each by its own text; the same id never counts as smaller.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.common import dropped, written

WINDOW, SHINGLE = 50, 10
MOST_CELLS, CELL_BLOCK, BYTES_AT_ONCE, PIECE = 1 << 27, 1 << 16, 1_000_000, 1_000_000
GAP, LONG = re.compile(rb"[\x20\x09-\x0D]+"), re.compile(rb"[^\x20\x09-\x0D]{4097,}")
#: Bytes of a digest.
DIGEST = 10
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A well-known 64-bit finalizer, by element."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _series(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed)) | _U(1)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash, number of its text) of every word of these texts, in order."""
    raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    inside = ~_SPACE[raw]
    if not inside.any():
        return np.zeros(0, _U), np.zeros(0, np.int64)
    first = inside & ~np.concatenate([[False], inside[:-1]])
    starts = np.flatnonzero(first)
    at = np.flatnonzero(inside)
    word = np.cumsum(first)[at] - 1
    place = at - starts[word]
    factors = _series(int(place.max()) + 1, 7)
    h = mix(np.add.reduceat((raw[at].astype(_U) + _U(1)) * factors[place], np.searchsorted(at, starts)))
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return h, np.searchsorted(np.cumsum(lengths), starts, side="right")


def segments(texts: list[bytes], window: int, shingle: int):
    """Runs of neighbouring windows with one anchor: (text, first word within the text, number of windows, anchor)."""
    h, doc = word_hashes([LONG.sub(lambda m: digest(m[0]).hex().encode(), t) for t in texts])
    n = len(h) - window + 1
    if n < 1:
        return None
    good = doc[:n] == doc[window - 1 :]
    grams = np.zeros(len(h) - shingle + 1, _U)
    for j, f in enumerate(_series(shingle, 11)):
        grams += h[j : j + len(grams)] * f
    grams = mix(grams)
    anchor = np.lib.stride_tricks.sliding_window_view(grams, window - shingle + 1).argmin(1) + np.arange(n)
    new = good & np.concatenate([[True], (anchor[1:] != anchor[:-1]) | ~good[:-1]])
    a = np.flatnonzero(new)
    if not len(a):
        return None
    stops = np.flatnonzero(good & np.concatenate([new[1:] | ~good[1:], [True]])) + 1
    firsts = np.searchsorted(doc, np.arange(len(texts)))
    return doc[a], a - firsts[doc[a]], stops - a, grams[anchor[a]]


def digest(x: bytes) -> bytes:
    return xxhash.xxh3_128_digest(x)[:DIGEST]


def digests(text: bytes, firsts: list[int], counts: list[int], window: int) -> tuple[list[bytes], list[bytes]]:
    """Of segments of a text, given by their first words and numbers of windows: the digest of all their words, and those of their windows end to end."""
    whole = GAP.sub(b" ", text).strip(b" ")
    starts = [0, *(np.flatnonzero(np.frombuffer(whole, np.uint8) == 32) + 1).tolist(), len(whole) + 1]  # of each word, and of one more behind the last
    of = [digest(whole[starts[a] : starts[a + k + window - 1] - 1]) for a, k in zip(firsts, counts, strict=True)]
    make = xxhash.xxh3_128_digest
    each = [b"".join([make(whole[f : z - 1])[:DIGEST] for f, z in zip(starts[a : a + k], starts[a + window : a + window + k], strict=True)]) for a, k in zip(firsts, counts, strict=True)]
    return of, each


def cells(anchors: np.ndarray, width: int) -> list[np.ndarray]:
    """The cell of each anchor in either row of the sketch; width is a power of two."""
    return [(mix(anchors + _U(seed)) & _U(width - 1)).astype(np.int64) for seed in (0x1234567, 0x89ABCDEF)]


def pieces(text: bytes, window: int) -> Iterator[tuple[int, bytes]]:
    """(words before it, piece): each window of the text lies in one piece."""
    more = re.compile(rb"(?:[\x20\x09-\x0D]++[^\x20\x09-\x0D]++){0,%d}" % (window - 1))
    at, base = 0, 0
    while len(text) - at > PIECE and (gap := GAP.search(text, at + PIECE)):
        yield base, text[at : more.match(text, gap.start()).end()]
        base += len(text[at : gap.start()].split())
        at = gap.start()
    yield base, text[at:]


def _groups(batches: Iterator[pa.RecordBatch], col: int, window: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, list[bytes]]]:
    """Texts of the batches as bytes, in pieces, about BYTES_AT_ONCE together: (batch, row and words before it of each piece, pieces)."""
    for b in batches:
        some, size = [], 0
        for i, t in enumerate(b.column(col)):
            for base, x in pieces((t.as_py() or "").encode("utf-8", "surrogatepass"), window):
                some.append((i, base, x))
                size += len(x)
                if size > BYTES_AT_ONCE:
                    yield b, np.array([r[0] for r in some]), np.array([r[1] for r in some]), [r[2] for r in some]
                    some, size = [], 0
        if some:
            yield b, np.array([r[0] for r in some]), np.array([r[1] for r in some]), [r[2] for r in some]


def sketch(docs: DataFrame, width: int, window: int, shingle: int) -> np.ndarray:
    """Bitmap (2 x width / 8 bytes) of the cells that a merged sketch of all anchors counts twice or more."""
    block = min(CELL_BLOCK, width)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((2, width), np.uint8)
        for _, row_of, _, texts in _groups(batches, 0, window):
            if (s := segments(texts, window, shingle)) is not None:
                doc, anchors = row_of[s[0]], s[3]
                _, once = np.unique(mix(anchors + doc.astype(_U) * _U(0x9E3779B97F4A7C15)), return_index=True)  # once a document
                for row, at in zip(table, cells(anchors[once], width), strict=True):
                    at, n = np.unique(at, return_counts=True)
                    row[at] = np.minimum(row[at] + np.minimum(n, 2), 2)
        flat = table.reshape(-1, block)
        some = np.flatnonzero(flat.any(1))
        me = TaskContext.get().partitionId()
        for i in some:
            yield pa.RecordBatch.from_arrays([pa.array([int(i)]), pa.array([me]), pa.array([zlib.compress(flat[i].tobytes(), 1)])], ["block", "part", "cells"])

    def total(t: pa.Table) -> np.ndarray:
        out = np.zeros(block, np.uint8)
        for c in t["cells"]:
            out = np.minimum(out + np.frombuffer(zlib.decompress(c.as_py()), np.uint8), 2)
        return out

    def merge(t: pa.Table) -> pa.Table:
        return pa.table({"block": t["block"][:1], "part": t["part"][:1], "cells": pa.array([zlib.compress(total(t).tobytes(), 1)])})

    def last(t: pa.Table) -> pa.Table:
        return pa.table({"block": t["block"][:1], "bits": pa.array([np.packbits(total(t) >= 2).tobytes()])})

    schema = "block bigint, part bigint, cells binary"
    parts = docs.select("text").mapInArrow(count, schema)
    # two levels, so that no task merges more than some hundred pieces however many partitions there are
    level = parts.withColumn("part", F.floor(F.col("part") / 128).cast("bigint")).groupBy("block", "part").applyInArrow(merge, schema)
    bits = np.zeros((2 * width // block, block // 8), np.uint8)
    for r in level.groupBy("block").applyInArrow(last, "block bigint, bits binary").collect():  # MOST_CELLS / 4 bytes at most
        bits[r[0]] = np.frombuffer(r[1], np.uint8)
    return bits.reshape(2, -1)


def _repeated(bits: np.ndarray, anchors: np.ndarray, width: int) -> np.ndarray:
    out = np.ones(len(anchors), bool)
    for row, at in zip(bits, cells(anchors, width), strict=True):
        out &= (row[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
    return out


def deduplicate(spark: SparkSession, docs: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, width: int | None = None, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and the kept text) of every row of documents."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    some = rows.where("doc_id is not null")
    if width is None:
        size = some.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        width = min(MOST_CELLS, 1 << max(16, (size // 30).bit_length()))
    sent = spark.sparkContext.broadcast(sketch(some, width, window, shingle))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for b, row_of, before, texts in _groups(batches, 2, window):
            if (s := segments(texts, window, shingle)) is None:
                continue
            doc, first, k, anchors = s
            pick = np.flatnonzero(_repeated(bits, anchors, width))
            if not len(pick):
                continue
            of, each = [], []
            cuts = np.flatnonzero(np.diff(doc[pick], prepend=-1))
            for a, z in zip(cuts, [*cuts[1:], len(pick)], strict=True):
                got = digests(texts[doc[pick[a]]], first[pick[a:z]].tolist(), k[pick[a:z]].tolist(), window)
                of += got[0]
                each += got[1]
            where = pa.array(row_of[doc[pick]])
            yield pa.RecordBatch.from_arrays([b.column(0).take(where), b.column(1).take(where), pa.array(anchors[pick].view(np.int64)), pa.array(of, pa.binary()), pa.array((first + before[doc])[pick].astype(np.int32)), pa.array(k[pick].astype(np.int32)), pa.array(each, pa.binary())], ["doc_id", "th", "a", "s", "start", "k", "w"])

    found = written(spark, some.select("doc_id", "th", "text").mapInArrow(candidates, "doc_id bigint, th bigint, a bigint, s binary, start int, k int, w binary"), "segments")
    kinds = written(spark, found.groupBy("a", "s").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.first("w").alias("w")), "kinds")
    anchors = written(spark, kinds.groupBy("a").agg(F.min("first").alias("lo"), F.max("last").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("a", "n"), "anchors")
    shared = kinds.join(anchors, "a")
    each_window = F.transform(F.sequence(F.lit(0), F.floor(F.octet_length("w") / DIGEST).cast("int") - 1), lambda i: F.substring("w", i * DIGEST + 1, F.lit(DIGEST)))
    unlike = written(spark, shared.where("n > 1").select("a", "s", "first", F.posexplode(each_window).alias("i", "win")), "unlike")
    least = written(spark, unlike.groupBy("a", "win").agg(F.min("first").alias("least")), "least")
    by_window = unlike.join(least, ["a", "win"]).groupBy("a", "s").agg(F.collect_list(F.struct("i", "least")).alias("each"))
    whole = shared.where("n = 1 and first < last").select("a", "s", F.lit(None).cast("array<struct<i:int,least:bigint>>").alias("each"), "first")
    verdict = written(spark, by_window.withColumn("first", F.lit(None).cast("bigint")).unionByName(whole), "verdicts")
    hit = found.select("doc_id", "th", "a", "s", "start", "k").join(verdict, ["a", "s"])
    spans = F.when(F.col("each").isNull(), F.when(F.col("first") < F.col("doc_id"), F.array(F.struct(F.col("start").alias("f"), (F.col("start") + F.col("k") - 1).alias("t"))))).otherwise(F.transform(F.filter("each", lambda x: x["least"] < F.col("doc_id")), lambda x: F.struct((F.col("start") + x["i"]).alias("f"), (F.col("start") + x["i"]).alias("t"))))
    hit = hit.select("doc_id", "th", spans.alias("spans")).where("size(spans) > 0")
    gone = written(spark, hit.groupBy("doc_id", "th").agg(F.flatten(F.collect_list("spans")).alias("spans")), "removed")
    for df in (kinds, anchors, unlike, least, verdict, found):
        dropped(spark, df)

    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * texts

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in names[1:]]
            for t, spans in zip(b.column(1), b.column(2), strict=True):
                kept = GAP.sub(b" ", (t.as_py() or "").encode("utf-8", "surrogatepass")).strip(b" ")
                n, left = (kept.count(b" ") + 1 if kept else 0), None
                if spans.is_valid:
                    gone = np.zeros(n, bool)
                    for f, to in zip(*(spans.values.field(x).to_pylist() for x in ("f", "t")), strict=True):
                        gone[f : to + window] = True
                    ws = [w for w, g in zip(kept.split(b" "), gone.tolist(), strict=True) if not g]
                    kept, left = b" ".join(ws), len(ws)
                for col, x in zip(out, (n, 0 if left is None else n - left, hashlib.sha256(kept).hexdigest(), *([kept.decode("utf-8", "surrogatepass")] * texts)), strict=True):
                    col.append(x)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, k) for x, k in zip(out, kinds, strict=False))], names)

    both = rows.join(gone.select(F.col("doc_id").alias("id"), F.col("th").alias("h"), "spans"), (F.col("doc_id") == F.col("id")) & (F.col("th") == F.col("h")), "left")
    return both.select("doc_id", "text", "spans").mapInArrow(cut, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept_text string" * texts)
