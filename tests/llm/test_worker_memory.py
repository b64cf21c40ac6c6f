"""What a Python worker holds during a step and after it."""

import tracemalloc

import numpy as np
import pyarrow as pa

from sieveline.llm import packing, toxicity
from sieveline.llm.tokens import ids_of, paths


def test_chunks_are_forgotten_after_a_task(spark, monkeypatch):
    got = []
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: got.append(f))
    packing.pieces(docs)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["some words of a text", None])], ["doc_id", "text"])
    assert [b.num_rows for b in got[0](iter([batch, batch]))] == [2, 2]
    assert not ids_of(paths()) and not ids_of(paths()).held
    assert ids_of(paths()).most <= 32 << 20


def test_counts_of_grams_and_costs_take_little(monkeypatch):
    text = "the quick brown fox, it jumps; " * 60_000
    toxicity.codes()
    tracemalloc.start()
    whole = toxicity.count_grams([text])
    assert tracemalloc.get_traced_memory()[1] < 40e6
    tracemalloc.reset_peak()
    cost = toxicity.model(whole)
    held = tracemalloc.get_traced_memory()[0]
    read = toxicity.Reader(cost)
    assert tracemalloc.get_traced_memory()[0] - held < 5e6
    tracemalloc.stop()
    assert list(read.cost[:50]) == cost[:50].tolist()
    monkeypatch.setattr(toxicity, "PART", 7)
    short = text[:500]
    n = toxicity.count_grams([short])
    monkeypatch.undo()
    assert (n == toxicity.count_grams([short])).all() and n.sum() == 500 + 2 - 3 and not toxicity.count_grams([]).any()


def test_a_kept_text_is_sent_once(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"word{i % 7} of text", "en") for i in range(40)], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, toxic int")
    sent, real = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema, *a: sent.append(self.schema) or real(self, f, schema, *a))
    kept = toxicity.score_documents(spark, docs, labels, ("doc_id", "text", "lang"))
    assert sum(f.name in ("__text", "kept_1") for f in sent[-1]) == 1
    plain = {r.doc_id: r.score for r in toxicity.score_documents(spark, docs, labels).collect()}
    rows = kept.collect()
    assert {r.doc_id: r.score for r in rows} == plain and {(r.kept_0, r.kept_1, r.kept_2) for r in rows} == {tuple(r) for r in docs.collect()}


def test_features_are_handed_on_before_there_are_many(spark, monkeypatch):
    steps, real = [], type(spark.range(0)).mapInArrow
    docs = spark.createDataFrame([(i, f"word{i} of text", "en") for i in range(40)], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, toxic int")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema, *a: (steps.append(f) if "feature" in str(schema) else None) or real(self, f, schema, *a))
    toxicity.train(spark, docs, labels)
    texts = [f"letter{chr(97 + i)}{chr(98 + i)} again" for i in range(20)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(np.arange(20) % 2)], ["text", "toxic"])

    def summed() -> tuple[int, dict]:
        got = [b.to_pydict() for b in steps[0](iter([batch, batch]))]
        out: dict = {}
        for g in got:
            for f, p, n in zip(g["feature"], g["pos"], g["neg"], strict=True):
                a, z = out.get(f, (0, 0))
                out[f] = a + p, z + n
        return max(len(g["feature"]) for g in got), out

    whole = summed()
    monkeypatch.setattr(toxicity, "MANY", 20)
    few = summed()
    assert few[1] == whole[1] and few[0] < whole[0] and few[0] <= 30
