import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from sieveline.llm import mixing, packing
from sieveline.llm.tokens import ODD, ids_of, paths


@pytest.fixture(scope="module")
def exact():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(paths()[0])


def test_quick_ids_equal_the_reference_tokenizer(exact):
    ids = ids_of(paths())
    chars = [chr(c) for c in range(0x250)] + [" ", "日", "😀"]
    texts = ["a" + c + "b " + c + c + " 1" + c + "\n" + c for c in chars] + ["  two  spaces \n\n x ", "\n", " ", "don't we'll I'm", "a<|endoftext|>b <|endoftext|>", "x\r\ny\tz", "Straße 123,45 – ok"]
    for t in texts:
        assert ids.of(t) == np.array(exact.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), repr(t)
    assert not ODD.search("plain é ñ ß\n") and ODD.search("\t")


def check_packing(rows, docs, exact, capacity):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    for part in by_seq.values():
        at = 0
        for r in sorted(part, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    for d, texts in docs.items():
        want = []
        for t in texts:
            ids = np.array(exact.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
            n = len(ids)
            cuts = [0, *range(n % capacity or capacity, n, capacity), n] if n > capacity else [0, n]
            want += [(i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in by_doc[d]) == sorted(want)
    return len(by_seq)


def test_packing_is_whole_and_tight(spark, odd_docs, no_docs, exact):
    _, wide, rows = odd_docs
    docs = defaultdict(list)
    for d, t, *_ in rows:
        docs[d].append(t)
    got = packing.pack_documents(spark, wide).collect()
    n = check_packing(got, docs, exact, 2048)
    assert n <= -(-sum(r["length"] for r in got) // 2048) + 1
    assert packing.pack_documents(spark, no_docs).count() == 0


@pytest.mark.parametrize("leaf", [7, 60])
def test_merging_over_several_levels(spark, leaf):
    r = np.random.default_rng(4)
    rows = [(i, 0, 0, int(n), i) for i, n in enumerate(r.integers(1, 100, 900))] + [(1000 + i, 0, 0, 55, 0) for i in range(200)]
    made = spark.createDataFrame(rows, packing.pieces(spark.createDataFrame([], "doc_id bigint, text string")).schema)
    got = packing.pack(spark, made, capacity=100, leaf=leaf).collect()
    by_seq = defaultdict(list)
    for x in got:
        by_seq[x["sequence_id"]].append((x["offset"], x["length"]))
    assert len(got) == len(rows)
    for part in by_seq.values():
        at = 0
        for offset, length in sorted(part):
            assert offset == at
            at += length
        assert at <= 100
    _, _, loads = packing.best_fit(np.sort([x[3] for x in rows])[::-1], 100)
    assert len(by_seq) <= len(loads) * 1.25


def up_the_tree(groups, capacity, chosen):
    """The number of sequences when groups of FAN hand up the bins chosen(loads, levels above), until one group is left."""
    done = 0
    while True:
        levels = packing._levels(len(groups), 1)
        up = [chosen(g, levels) for g in groups]
        if levels == 0:
            return done + sum(map(len, groups))
        done += sum(int((~u).sum()) for u in up)
        kept = [g[u] for g, u in zip(groups, up, strict=True)]
        merged = [np.concatenate(kept[i : i + packing.FAN]) for i in range(0, len(kept), packing.FAN)]
        groups = [packing.best_fit(np.sort(m)[::-1], capacity)[2] for m in merged]


def test_no_host_that_a_bin_could_take_stays_behind():
    r = np.random.default_rng(8)
    cases = [[np.array([70] * 3 + [90] * 1000), *([np.array([30])] * 3)], [np.array([97] * 400 + [99] * 400), np.array([1]), np.array([3]), np.array([2])]]
    cases += [[np.concatenate([r.integers(lo, 100, r.integers(0, 600)), r.integers(1, 50, 1)]) for lo in r.integers(51, 100, n)] for n in (16, 40, 300)]
    for case in cases:
        whole = up_the_tree(case, 100, lambda g, _: np.ones(len(g), bool))
        assert up_the_tree(case, 100, lambda g, levels: packing.handed_up(g, 100, *([levels] if levels > 1 else []))) == whole
    # and what goes up is bounded by the room there is, not by the bins
    assert packing.handed_up(r.integers(51, 100, 100_000), 100, 2).sum() <= 49 * packing.FAN * 2


def brute_targets(size):
    names = sorted((s for s in size if s is not None)) + [None] * (None in size)
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    out, free, rest = {}, set(names), float(sum(size.values()))
    while free:
        share = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * size[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = 3.0 * size[s]
            free.remove(s)
            rest -= out[s]
    return out


def brute_mix(rows, slots, golden):
    """taken and first slot of every (doc_id, text, source) row, straight from the schedule's definition, word by word."""
    size = [len((t or "").encode().split()) for _, t, _ in rows]
    of = defaultdict(int)
    for n, (_, _, s) in zip(size, rows, strict=True):
        of[s] += n
    target, total = brute_targets(of), sum(size)
    block = max(1, -(-total // slots))
    names = sorted((s for s in of if s is not None)) + [None] * (None in of)
    blocks = {s: -(-of[s] // block) for s in names}
    need = {s: of[s] and round(target[s]) // of[s] * blocks[s] + -(-(round(target[s]) % of[s]) // block) for s in names}
    line = [s for s in names for _ in range(need[s])]
    takes = defaultdict(list)
    ranks = Counter()
    for k in range(len(line)):
        x = (k + 0.5) * golden
        s = line[min(len(line) - 1, int((x - int(x)) * len(line)))]
        if ranks[s] < 3 * blocks[s]:
            takes[s, ranks[s] % blocks[s]].append(k)
        ranks[s] += 1
    out = {}
    for s in names:
        mine = sorted((hashlib.md5(f"{'' if rows[i][0] is None else rows[i][0]}|{rows[i][1] or ''}".encode()).hexdigest(), i) for i in range(len(rows)) if rows[i][2] == s)
        at = 0
        for _, i in mine:
            got = [takes[s, w // block] for w in range(at, at + size[i])]
            out[i] = (sum(map(len, got)), min((k for g in got for k in g), default=-1))
            at += size[i]
    return [out[i] for i in range(len(rows))], {s: (of[s], target[s]) for s in names}


def told(rows):
    return sorted(map(str, rows))


@pytest.mark.parametrize("slots", [300, 1 << 20])
def test_mixing_is_the_schedule(spark, odd_docs, no_docs, monkeypatch, slots):
    monkeypatch.setattr(mixing, "SLOTS", slots)
    _, wide, rows = odd_docs
    got = mixing.mix_documents(spark, wide).collect()
    assert told(got) == told(mixing.mix_documents(spark, wide.repartition(3)).collect())
    plain = [(d, t, s) for d, t, _, s, _ in rows]
    want, sources = brute_mix(plain, slots, mixing.GOLDEN)
    assert sorted(str((r["doc_id"], r["taken"], r["first_slot"])) for r in got) == sorted(str((d, *w)) for (d, _, _), w in zip(plain, want, strict=True))
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    by = defaultdict(int)
    for r in got:
        by[r["source_size"], round(r["target"], 6)] += r["taken"]
    block = max(1, -(-sum(n for n, _ in sources.values()) // slots))
    assert all(abs(by[n, round(t, 6)] - t) <= 4 * block for n, t in sources.values())
    assert mixing.mix_documents(spark, no_docs).count() == 0


def test_the_points_decide_the_mix(spark, odd_docs, monkeypatch):
    _, wide, rows = odd_docs
    plain = [(d, t, s) for d, t, _, s, _ in rows]
    golden = told(mixing.mix_documents(spark, wide).select("doc_id", "taken").collect())
    for other in (0.5, 0.137):
        monkeypatch.setattr(mixing, "GOLDEN", other)
        got = mixing.mix_documents(spark, wide).collect()
        want, _ = brute_mix(plain, mixing.SLOTS, other)
        assert sorted(str((r["doc_id"], r["taken"])) for r in got) == sorted(str((d, w[0])) for (d, _, _), w in zip(plain, want, strict=True))
        assert told([(r["doc_id"], r["taken"]) for r in got]) != golden


def test_repeated_ids_of_unlike_size_do_not_show_the_layout(spark):
    rows = [(None if i % 3 else 7, "w " * (1 + i % 11) + f"x{i % 13}", "a" if i % 2 else "b") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    a, b = (told(mixing.mix_documents(spark, x).collect()) for x in (docs.repartition(1), docs.repartition(7)))
    assert a == b


def test_small_sources_are_capped(spark):
    rows = [(i, " ".join(["w"] * n), None, s, None) for i, (s, n) in enumerate([("a", 2), ("b", 500), ("c", 500), ("d", 0), (None, 3)])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").selectExpr("*", "1 as row", "2 as c0", "3 as slot", "4 as part", "5 as slots")
    got = {r["doc_id"]: r for r in mixing.mix_documents(spark, docs).collect()}
    want = brute_targets({"a": 2, "b": 500, "c": 500, "d": 0, None: 3})
    for r in rows:
        assert abs(got[r[0]]["target"] - want[r[3]]) < 1e-6 and abs(got[r[0]]["taken"] - want[r[3]]) <= 2
    mixed = mixing.mixed_documents(spark, docs)
    assert mixed.columns == docs.columns
    times = Counter(r["doc_id"] for r in mixed.collect())
    assert times == {d: n for d, r in got.items() if r["size"] and (n := int(r["taken"] / r["size"] + 0.5))}
    assert mixing.mixed_documents(spark, docs.limit(0)).count() == 0


def test_files_of_the_mix_are_in_slot_order(spark):
    rows = [(i, f"w{i} " * 20, f"s{i % 3}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    from pyspark.sql import functions as F

    known = {r["doc_id"]: r for r in mixing.mixed(spark, mixing._rows(docs, F.monotonically_increasing_id())).collect()}
    parts = mixing.mixed_documents(spark, docs).rdd.glom().collect()
    times = Counter(r["doc_id"] for part in parts for r in part)
    once = {d: (k["slots"] or [k["first_slot"]])[0] for d, k in known.items() if times[d] == 1}
    assert len(once) > 50
    for part in parts:
        slots = [once[r["doc_id"]] for r in part if r["doc_id"] in once]
        assert slots == sorted(slots)
