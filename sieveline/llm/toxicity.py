"""Toxicity by noisy-channel deobfuscation and a linear model over restored words.

Obfuscated words (look-alike characters, letters spaced apart, letters repeated) are read as a noisy
channel: each gives a lattice of what its characters may stand for, and Viterbi decoding under a character
4-gram model, counted over all documents, restores the likeliest text. A word without any of these signs, a doubled letter included, has one path only,
itself, so it is not decoded. Single characters are decoded together with the words at their sides; a word in pieces of two or
more letters each, with no single letter among them, is not put together. The score is a logistic model over words and word beginnings of restored texts.

Labels are learnt only from rows whose crc32(doc_id as text) mod 5 is not 0, from about TRAIN_ROWS of them drawn by
a hash of their id (a documented bound), copies of a text counted once; a feature must stand in the share SUPPORT of those labelled 1. All else
covers all documents. Scores use the text alone.

Null and empty texts get the score of a text without signs. A null doc_id counts as the text ''. Without labels of both kinds
the score is the smoothed share of label 1. Repeated rows are each scored; of repeated labels the largest counts.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.common import dropped, lean, written
from sieveline.llm.tokens import Bounded

TRAIN_ROWS, FEATURES, SUPPORT = 20_000, 1500, 0.01
#: Codes: 0 anything that is no letter, 1-26 a-z, 27 other letters. ORDER letters make a gram.
SIZE, ORDER = 28, 4
#: What a look-alike character may stand for; separators that may stand for nothing.
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "tl", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i"}
SEPARATORS = " .-_*~'·•/\\,"
#: Costs in nats of reading a look-alike as a letter, of dropping a repeated letter or a separator, of keeping a character as no letter.
SWAP, DROP, KEEP = 0.5, 0.3, 4.0
#: Codes counted at once, and features counted before they are handed on: what bounds a task's memory; sums are the same.
PART, MANY = 1 << 18, 50_000
#: Marks around a plain word; a letter twice in a row; a run of what is no letter, and what in it may stand for a letter before and behind one.
AROUND = ".,;:?!\"'()[]{}<>%&#*-_"
TWICE = re.compile(r"([^\W\d_])\1")
REPEATED = re.compile(r"(.)\1+", re.S)
OTHER = re.compile(r"[\W\d_]+")
BEFORE, BEHIND = re.compile(r"[0-9@$!|+(€£¡]"), re.compile(r"[0-9@$|+(€£¡]")


def core(word: str) -> str:
    """The word without marks at its ends that cannot stand for letters; @ and $ at the end go if three or more stand together. One step a character."""
    a, z = 0, len(word)
    word_like = lambda c: c.isalnum() or c == "_"
    while a < z and not word_like(word[a]) and word[a] not in "@$!|":
        a += 1
    while z > a and not word_like(word[z - 1]):
        if word[z - 1] not in "@$":
            z -= 1
            continue
        k = z
        while k > a and word[k - 1] in "@$":
            k -= 1
        if z - k < 3:
            break
        z = k
    k = a
    while k < z and word[k] in "!|":
        k += 1
    return word[k if k > a and (k == z or not word_like(word[k])) else a : z]


def disguised(w: str) -> bool:
    """Whether a lower-case word has a sign of disguise: a doubled letter, or characters beside letters that may stand for some or for nothing."""
    if TWICE.search(w):
        return True
    for m in OTHER.finditer(w):
        before, after = "a" <= w[m.start() - 1 : m.start()] <= "z", "a" <= w[m.end() : m.end() + 1] <= "z"
        if before and after or after and BEFORE.search(w, *m.span()) or before and BEHIND.search(w, *m.span()):
            return True
    return False


def code(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27 if c.isalpha() else 0


_codes: list[np.ndarray] = []


def codes() -> np.ndarray:
    """code() of every character, as a table; made once in each worker."""
    if not _codes:
        _codes.append(np.fromiter(map(code, map(chr, range(0x110000))), np.uint8, 0x110000))
    return _codes[0]


def count_grams(texts: list[str]) -> np.ndarray:
    """Counts of all ORDER-grams of codes in these texts, lower-cased."""
    c = codes()[np.frombuffer("\0".join(["", *texts, ""]).lower().encode("utf-32-le", "surrogatepass"), "<u4")]
    total = np.zeros(SIZE**ORDER, np.int64)
    for at in range(0, len(c) - ORDER + 1, PART):
        p = c[at : at + PART + ORDER - 1].astype(np.int64)
        total += np.bincount(((p[:-3] * SIZE + p[1:-2]) * SIZE + p[2:-1]) * SIZE + p[3:], minlength=SIZE**ORDER)
    return total


def gram_counts(docs: DataFrame) -> np.ndarray:
    """The 4-gram counts of all documents, summed by the cluster; SIZE**ORDER numbers whatever the input."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE**ORDER, np.int64)
        for b in batches:
            texts, size = [], 0
            for t in b.column(0):
                texts.append(t.as_py() or "")
                size += len(texts[-1])
                if size > 2_000_000:
                    total += count_grams(texts)
                    texts, size = [], 0
            total += count_grams(texts)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["gram", "n"])

    got = docs.select(F.col("text").cast("string")).mapInArrow(lean(count), "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(SIZE**ORDER, np.int64)
    total[got["gram"].to_numpy()] = got["n"].to_numpy()
    return total


def model(counts: np.ndarray) -> np.ndarray:
    """-log p(code | three codes before), interpolated over orders 0 to 3."""
    c = counts.reshape((SIZE,) * ORDER).astype(float)
    p = np.full((SIZE,), 1.0 / SIZE)
    for order in range(ORDER):
        some = c.sum(axis=tuple(range(ORDER - 1 - order))) if order < ORDER - 1 else c
        p = (some + 5.0 * p) / (some.sum(-1, keepdims=True) + 5.0)
    return -np.log(p).reshape(-1).astype(np.float32)


@lru_cache(maxsize=10_000)
def readings(c: str, again: bool, inside: bool) -> tuple[tuple[str, int, float], ...]:
    """What one character of the lattice may be read as: (letter, ' ' or nothing; its code, or -1; cost). again: it repeats the one before; inside: it stands between others."""
    if c in LOOKALIKES:
        out = [*((x, SWAP) for x in LOOKALIKES[c]), (" ", KEEP)]
    elif c in SEPARATORS:
        out = [("", DROP if inside else 0.0), (" ", DROP)]
    elif not c.isalpha():
        out = [("", DROP * 4), (" ", KEEP)]
    else:
        out = [(c, 0.0), ("", DROP)] if again else [(c, 0.0)]
    return tuple((x, code(x) if x else -1, price) for x, price in out)


def viterbi(segment: str, cost: array) -> str:
    """The likeliest reading of a lower-case segment. States are the last three codes read, and all that arise are followed; a path is a chain of
    (letter, path before), so time and memory grow with the segment's length."""
    states: dict[int, tuple] = {0: (0.0, None)}
    before, last = "", len(segment) - 1
    for i, c in enumerate(segment):
        options = readings(c, c == before, 0 < i < last)
        before = c
        new: dict[int, tuple] = {}
        for out, k, price in options:
            for s, (total, path) in states.items():
                if k < 0 or k == 0 and s % SIZE == 0 and out == " ":
                    t, z = s, total + price
                else:
                    t = s * SIZE + k
                    z, t, path = total + price + cost[t], t % SIZE**3, (out, path)
                if t not in new or z < new[t][0]:
                    new[t] = (z, path)
        states = new
    path = min(((z + cost[s * SIZE], s) for s, (z, _) in states.items()))[1]
    path, out = states[path][1], []
    while path:
        out.append(path[0])
        path = path[1]
    return "".join(reversed(out)).strip()


class Reader(Bounded):
    """word -> features of its restored form; a bounded memory of words."""

    def __init__(self, cost: np.ndarray, only: dict[str, int] | None = None):
        super().__init__()
        self.cost, self.only = array("f", cost.astype(np.float32).tobytes()), only
        # a word whose first letters begin no feature has none
        self.starts = None if only is None else {f.removesuffix("$")[:4] for f in only}
        # of letters alone a reading drops repeats and no more, so both are alike without repeats: all of a short word, of others how they begin
        self.short, self.single = ({REPEATED.sub(r"\1", s) for s in self.starts or () if (len(s) < 4) is short} for short in (True, False))

    def without_features(self, letters: str) -> bool:
        """Whether no reading of a lower-case word of letters alone can begin a feature."""
        s = REPEATED.sub(r"\1", letters)
        return not (s in self.short or s[:4] in self.single or s[:3] in self.single or s[:2] in self.single or s[:1] in self.single)

    def restore(self, word: str) -> str:
        w = core(word.lower())
        return viterbi(w, self.cost) if disguised(w) else w

    def __missing__(self, word: str) -> tuple:
        if (w := word.strip(AROUND).lower()).isalpha() and not TWICE.search(w):
            if self.starts is not None and w[:4] not in self.starts:
                return self.keep(word, (), 0)
            parts = (w,)  # nothing to restore
        elif self.starts is not None and (c := core(word.lower())).isalpha() and self.without_features(c):
            return self.keep(word, (), 0)
        else:
            parts = [w.strip(AROUND) for w in self.restore(word).split()]
        out: set = set()
        for w in parts:
            if w and (self.starts is None or w[:4] in self.starts):
                out.update([w + "$", *(w[:n] for n in (4, 5, 6, 7, 8) if len(w) > n)])
        got = tuple(out) if self.only is None else tuple(self.only[f] for f in out if f in self.only)
        return self.keep(word, got, sum(map(len, got)) + 60 * len(got) if self.only is None else 8 * len(got))

    def features(self, text: str | None) -> set:
        """Features of a whole text: of its words, and of runs of single characters, alone if three or more and with the words at their sides, read as one segment."""
        ws = (text or "").split()
        found: set = set()
        for f in map(self.__getitem__, set(ws)):
            if f:
                found.update(f)
        shape = bytes(map((1).__eq__, map(len, ws)))
        for m in re.finditer(b"\1+", shape):
            at, end = m.span()
            before, after = max(0, at - 1), min(len(ws), end + 1)
            parts = {(before, end), (at, after), (before, after)} if any(map(str.isalpha, ws[at:end])) else set()
            for a, z in parts - {(at, end)} | ({(at, end)} if end - at > 2 else set()):
                if len(set(ws[a:z])) > 1:
                    part = " ".join(ws[a:z]).lower()
                    if len(part) <= 40:
                        found.update(self[part])
                    else:
                        for w in viterbi(part, self.cost).split():
                            found.update(self[w])
        return found

    def restored(self, text: str | None) -> str:
        """The text with each word restored."""
        return " ".join(self.restore(w) for w in (text or "").split())


def remainder(doc_id: Column, n: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def fit_logistic(rows: list[tuple[np.ndarray, int]], n: int, l2: float = 0.05, rounds: int = 1500) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model over binary features, by accelerated gradient steps."""
    y = np.array([r[1] for r in rows], float)
    at = np.concatenate([np.full(len(r[0]), i) for i, r in enumerate(rows)]) if rows else np.zeros(0, int)
    f = np.concatenate([r[0] for r in rows]) if rows else np.zeros(0, int)
    w, b = np.zeros(n), math.log((y.sum() + 0.5) / (len(y) - y.sum() + 1.5))
    if not 0 < y.sum() < len(y):
        return w, b
    curve = np.bincount(f, minlength=n) / 4 * np.bincount(at, minlength=1).max(initial=1) ** 0.5 + l2
    vw, vb = w.copy(), b
    for k in range(rounds):
        p = 1 / (1 + np.exp(-(np.bincount(at, vw[f], len(y)) + vb)))
        gw, gb = np.bincount(f, (p - y)[at], n) + l2 * vw, (p - y).sum()
        w1, b1 = vw - gw / curve, vb - gb / (len(y) / 4)
        vw, vb = w1 + k / (k + 3) * (w1 - w), b1 + k / (k + 3) * (b1 - b)
        w, b = w1, b1
    return w, b


def counted(n: tuple[Counter, Counter]) -> pa.RecordBatch:
    """(feature, pos, neg) of counts by label 0 and 1."""
    both = list(n[0].keys() | n[1].keys())
    return pa.RecordBatch.from_arrays([pa.array(both, pa.string()), pa.array([n[1][f] for f in both], pa.int64()), pa.array([n[0][f] for f in both], pa.int64())], ["feature", "pos", "neg"])


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> dict:
    """The model's parts: gram costs, features, weights, bias. Their sizes are fixed by this module's constants."""
    sc = spark.sparkContext
    cost = model(gram_counts(docs))
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic")).where(remainder(F.col("doc_id"), 5) != 0)
    n = known.count()
    share = F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1 << 30)) < int(min(1.0, rows / max(1, n)) * (1 << 30))
    # about `rows` rows of two numbers: small enough to send to every task
    sample = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(known.where(share)), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic"))  # copies say a thing once
    sample = written(spark, sample, "labelled")
    sent = sc.broadcast(cost)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Reader(sent.value)
        n: tuple[Counter, Counter] = Counter(), Counter()
        for b in batches:
            for t, y in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                n[y > 0].update(read.features(t.as_py()))
                if len(n[0]) + len(n[1]) > MANY:
                    yield counted(n)
                    n[0].clear(), n[1].clear()
        yield counted(n)

    pos, neg = (float(x or 0) for x in sample.agg(F.sum(F.when(F.col("toxic") > 0, 1)), F.sum(F.when(F.col("toxic") <= 0, 1))).first())
    counts = sample.mapInArrow(lean(count), "feature string, pos bigint, neg bigint").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    # kept: features seen in enough documents of label 1 and far more often there, the strongest first
    rate1, rate0 = (F.col("pos") + 0.1) / (pos + 1), (F.col("neg") + 0.1) / (neg + 1)
    kept = counts.where((F.col("pos") >= max(4.0, SUPPORT * pos)) & (rate1 > 4 * rate0)).orderBy(F.desc(F.col("pos") * F.log(rate1 / rate0)), "feature").limit(FEATURES).collect()
    names = {r["feature"]: i for i, r in enumerate(kept)}
    sent_names = sc.broadcast(names)

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Reader(sent.value, sent_names.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([sorted(read.features(t.as_py())) for t in b.column(0)], pa.list_(pa.int32()))], ["toxic", "at"])

    # whole groups of equal rows travel as one with their number
    got = sample.mapInArrow(lean(hold), "toxic int, at array<int>").groupBy("toxic", "at").count().orderBy("toxic", "at").collect()
    dropped(spark, sample)
    data = [(np.array(r["at"], int), int(r["toxic"] > 0)) for r in got for _ in range(r["count"])]
    # a feature that all but never stands outside label 1 also is an example by itself, so that one such word is enough
    for r in kept:
        f = r["feature"]
        if r["pos"] >= max(20.0, 0.01 * pos) and (r["pos"] + 0.1) / (pos + 1) > 100 * (r["neg"] + 0.1) / (neg + 1):
            own = {names[x] for x in (f, *(f.rstrip("$")[:n] for n in range(4, len(f)))) if x in names}
            data += [(np.array(sorted(own), int), 1)] * 2
    w, b = fit_logistic(data, len(names))
    return {"cost": cost, "names": names, "weights": w, "bias": b}


def score_documents(spark: SparkSession, docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of documents, and the columns named in keep as kept_0, kept_1..."""
    sent = spark.sparkContext.broadcast(train(spark, docs, labels))
    extra = [f"kept_{i}" for i in range(len(keep))]
    # a text that is kept is sent once
    at = 2 + keep.index("text") if "text" in keep and docs.schema["text"].dataType.simpleString() == "string" else None
    text = [] if at is not None else [F.col("text").cast("string").alias("__text")]
    wide = docs.select(F.col("doc_id").cast("bigint").alias("__id"), (remainder(F.col("doc_id"), 5) == 0).alias("__held"), *(F.col(c).alias(e) for c, e in zip(keep, extra, strict=True)), *text)
    schema = ", ".join(["doc_id bigint", "held_out boolean", "score double", "predicted int", *(f"{e} {docs.schema[c].dataType.simpleString()}" for c, e in zip(keep, extra, strict=True))])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        read, w = Reader(m["cost"], m["names"]), m["weights"]
        for b in batches:
            z = np.array([m["bias"] + w[list(read.features(t.as_py()))].sum() if len(w) else m["bias"] for t in b.column(2 + len(extra) if at is None else at)], float)
            p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), *b.columns[2 : 2 + len(extra)]], ["doc_id", "held_out", "score", "predicted", *extra])

    return wide.mapInArrow(lean(score), schema)


def without_toxic(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, with their columns."""
    scored = score_documents(spark, docs, labels, tuple(docs.columns)).where("predicted = 0")
    return scored.select(*(F.col(f"kept_{i}").alias(c) for i, c in enumerate(docs.columns)))
