"""The pipeline's stages, each on its own input, and the registered corpus queries."""

import random

import corpus_pipeline as pipeline
from edge import documents, edge_documents
from __spark_entry__ import SMOKE_DIR, oracle_sql, queries
from oracle import compare, duck


def prose(rng, n=120):
    return " ".join("".join(rng.choice(["ta", "ri", "mon", "es", "le"]) for _ in range(3)) for _ in range(n))


def test_stages_keep_clean_documents_and_drop_what_they_are_for(spark, tmp_path):
    rng = random.Random(8)
    item = " ".join(f"item{rng.randint(0, 99)}" for _ in range(30))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    clean = [(i, prose(rng)) for i in range(30)]
    docs = documents(spark, [
        *clean, (40, "1234 !!"), (41, None), (42, clean[3][1]), (43, clean[4][1] + " " + item),
        (44, prose(rng) + " mail a@b.co"), (45, prose(rng, 4000)),
    ])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    gone = []
    for (name, stage), drops in zip(pipeline.STAGES, ({40, 41}, {42}, {43}, set(), None)):
        out = stage(spark, docs, str(tmp_path))
        if drops is None:
            assert ids(out) == ids(docs)
            break
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        out.write.parquet(str(tmp_path / f"out{len(gone)}"))
        out = spark.read.parquet(str(tmp_path / f"out{len(gone)}"))
        assert ids(docs) - ids(out) == drops, name
        gone, docs = [*gone, name], out
    assert "a@b.co" not in docs.where("doc_id = 44").first()["text"]
    whole = pipeline.run(spark, str(tmp_path))
    assert ids(whole) == ids(docs)


def test_evenly_mixed_documents_are_kept_however_many_languages_are_learned(spark):
    words = {f"l{i:02}": " ".join([chr(0x4E00 + 50 * i + k) * 3 for k in range(40)]) for i in range(60)}
    rows = [(3 * i, (text + " ") * 200, lang, "s", 200 * len(text) + 200) for i, (lang, text) in enumerate(words.items())]
    mixed = " ".join(words.values())
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([*rows, (200, mixed, None, "s", len(mixed)), (201, "12 !", None, "s", 4)], schema)
    kept = {r["doc_id"] for r in pipeline.identified(spark, docs, SMOKE_DIR).collect()}
    assert kept == {*range(0, 180, 3), 200}


def test_stages_take_odd_rows_and_empty_tables(spark):
    docs = edge_documents(spark, (30, "Plain words in a row, and more of them."))
    left = {}
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), SMOKE_DIR).count() == 0, name
        left[name] = sorted(str(r["doc_id"]) for r in stage(spark, docs, SMOKE_DIR).collect())
    everything = sorted(str(r["doc_id"]) for r in docs.collect())
    assert left["PII"] == left["benchmark decontamination"] == everything
    # One row of a repeated document stays; the blank texts are one group.
    assert left["SimHash near-dedup"] == sorted(["1", "4", "5", "None", "6", "7", "8"])
    assert left["language ID"] == sorted(["4", "5", "5", "None", "6", "7", "30"])
    assert set(left["best-fit packing"]) == set(everything)


def test_rows_without_an_id_are_dropped_and_kept_like_others(spark):
    rng = random.Random(9)
    item = " ".join(f"item{rng.randint(0, 99)}" for _ in range(30))
    text = prose(rng)
    docs = documents(spark, [(None, text), (1, text), (None, "x " + prose(rng)), (2, prose(rng)), (2, item)])
    assert pipeline.deduplicated(spark, docs, SMOKE_DIR).count() == 4
    found = pipeline._without(docs, lambda rows: pipeline.decontaminate.contaminated(
        rows, spark.createDataFrame([(1, item)], "item_id long, text string")))
    assert found.count() == 4 and found.where("doc_id = 2").count() == 1


def test_registered_queries(spark):
    names = [n for n in queries() if n.startswith("op") and n.split("_")[0][2:].isdigit()]
    assert sorted(int(n.split("_")[0][2:]) for n in names) == list(range(1, 14)) and "pipeline" in queries()
    con = duck(SMOKE_DIR)
    for name in names:
        if name in oracle_sql():
            rows, bad, _ = compare(spark, con, name, SMOKE_DIR)
            assert rows > 0 and bad == [], name
