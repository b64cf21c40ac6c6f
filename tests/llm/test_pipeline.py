from collections import defaultdict

from sieveline.llm import mixing, secrets, simhash, toxicity


def test_stages_keep_their_contracts(spark):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in p.STAGES] == ["toxicity", "near_dedup", "secret_scan", "mixing", "packing"]
    for name, stage in p.STAGES:
        out = stage(spark, docs, sf)
        rows = out.collect()
        if name == "packing":
            by_seq = defaultdict(int)
            for r in rows:
                by_seq[r["sequence_id"]] += r["length"]
            assert max(by_seq.values()) <= 2048
            assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in docs.select("doc_id").distinct().collect()}
            continue
        assert out.columns == docs.columns
        before = docs.collect()
        if name == "toxicity":
            bad = {r["doc_id"] for r in toxicity.score_documents(spark, docs, spark.read.parquet(f"{sf}/labels.parquet")).where("predicted = 1").collect()}
            assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in before} - bad
        if name == "near_dedup":
            comp = {r["component_id"] for r in simhash.near_duplicates(spark, docs).collect()}
            assert sorted(r["doc_id"] for r in rows) == sorted(comp)
        if name == "secret_scan":
            assert len(rows) == len(before) and not any(secrets.find_spans(r["text"]) for r in rows)
        if name == "mixing":
            taken = {r["doc_id"]: r for r in mixing.mix_documents(spark, docs).collect()}
            times = defaultdict(int)
            for r in rows:
                times[r["doc_id"]] += 1
            assert all(times[d] == int(t["taken"] / t["size"] + 0.5) for d, t in taken.items() if t["size"])
        docs = spark.createDataFrame(rows, docs.schema)


def test_run(spark):
    import corpus_pipeline as p

    out = p.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 0
