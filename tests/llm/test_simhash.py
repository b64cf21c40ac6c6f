import random
from collections import defaultdict

import numpy as np
import xxhash

from sieveline.llm import simhash


def brute_fingerprint(text, n=4):
    ws = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not ws:
        return 0
    grams = [" ".join(ws[i : i + n]) for i in range(len(ws) - n + 1)] or [" ".join(ws)]
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids, linked):
    parent = {i: i for i in ids}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    return {i: top(i) for i in ids}


def test_fingerprints_match_the_definition():
    r = random.Random(1)
    for _ in range(300):
        t = "".join(r.choice(["a", "B", "É", " ", "  ", "\t", "\n", "word", "Ab", " "]) for _ in range(r.randrange(40)))
        assert simhash.fingerprint(t) == brute_fingerprint(t), repr(t)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


def test_every_pair_within_the_radius_shares_a_table():
    masks = simhash.masks(list(range(64)), 4)
    r = random.Random(2)
    assert len(masks) == 31
    for _ in range(2000):
        x = sum(1 << p for p in r.sample(range(64), 4))
        assert any(not m & x for m in masks)


def test_links_lose_none_also_through_the_second_level(spark):
    r = np.random.default_rng(3)
    fps = set()
    for base in r.integers(0, 2**63, 12, dtype=np.uint64):
        for _ in range(40):
            x = int(base)
            for p in r.choice(64, r.integers(0, 8), replace=False):
                x ^= 1 << int(p)
            fps.add(simhash.signed(x))
    fps = sorted(fps)
    u = np.array(fps, np.int64).view(np.uint64)
    near = np.argwhere(np.bitwise_count(u[:, None] ^ u[None, :]) <= 4)
    want = components(fps, [(fps[a], fps[b]) for a, b in near])
    df = spark.createDataFrame([(x,) for x in fps], "fp bigint")
    for limit in (8192, 3):
        got = components(fps, [(e["a"], e["b"]) for e in simhash.links(spark, df, 4, limit).collect()])
        assert got == want


def test_query_against_brute_force(spark, odd_docs, no_docs):
    _, wide, rows = odd_docs
    got = simhash.near_duplicates(spark, wide).collect()
    assert len(got) == len(rows)
    by_fp = defaultdict(list)
    for d, t, *_ in rows:
        by_fp[brute_fingerprint(t)].append(d)
    keys = list(by_fp)
    top = components(keys, [(a, b) for a in keys for b in keys if (a ^ b).bit_count() <= 4])
    least = defaultdict(list)
    for k in keys:
        least[top[k]] += [d for d in by_fp[k] if d is not None]
    want = sorted((str(d), f"{brute_fingerprint(t):016x}", min(least[top[brute_fingerprint(t)]], default=None)) for d, t, *_ in rows)
    assert sorted((str(g["doc_id"]), g["fingerprint"], g["component_id"]) for g in got) == want
    assert simhash.near_duplicates(spark, no_docs).count() == 0


def test_one_of_each_group_stays(spark, odd_docs, no_docs):
    docs, _, rows = odd_docs
    kept = simhash.deduplicated(spark, docs)
    assert kept.columns == docs.columns
    comp = {g["doc_id"]: g["component_id"] for g in simhash.near_duplicates(spark, docs).collect()}
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({c for i, c in comp.items() if i is not None})
    assert ids.count(None) == sum(r[0] is None for r in rows)
    assert simhash.deduplicated(spark, no_docs).count() == 0


def test_rows_that_share_an_id_but_not_a_text_stay(spark):
    a, b = ("alpha beta gamma delta epsilon zeta eta theta " * 9, "one two three four five six seven eight nine ten " * 9)
    rows = [(1, a), (1, b), (1, b), (2, a), (3, b), (4, "something else entirely, with words of its own"), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as keep_id", "2 as c0", "3 as label", "4 as th")
    kept = simhash.deduplicated(spark, docs)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"] or 0), r["text"]) for r in kept.collect()) == sorted([(0, a), (1, a), (1, b), (4, rows[5][1])])


def test_components_of_long_chains(spark):
    from sieveline.llm.components import connected_components

    n = 300
    edges = [(i, i + 1) for i in range(n)] + [(1000, 1001), (5, 5), (1001, 1000)]
    got = {r["node"]: r["label"] for r in connected_components(spark, spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {1000: 1000, 1001: 1000}
    assert connected_components(spark, spark.createDataFrame([], "a bigint, b bigint")).count() == 0
