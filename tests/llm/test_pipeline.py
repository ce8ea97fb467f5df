"""The pipeline's stages in order, each against its operator's brute force, and the contract of its columns."""

import corpus_pipeline
from opinionmill.llm import decontamination, simhash

from .test_near import slow_dedup, slow_groups
from .test_texts import slow_rules

DATA = "/root/testdata/sf0.001"


def test_nulls_repeats_and_empty_tables(spark, tmp_path):
    good = " ".join(f"word{i} and text{i}" for i in range(30))
    rows = [(1, good, "en", None, None, "x"), (1, good, "en", "s", 5, "x"), (None, good + " more", None, None, None, None), (2, None, None, None, None, "x"), (3, "", "en", "s", 0, "x")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, spans string"
    for name, kept in (("some", rows), ("none", [])):
        folder = tmp_path / name
        spark.createDataFrame(kept, schema).write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame([(1, None), (None, "an item that stands in no document at all here")], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
        packed = corpus_pipeline.run(spark, str(folder)).collect()
        assert (len(packed) > 0) == bool(kept) and {r["doc_id"] for r in packed} <= {1, None}


def test_stages_work_on_what_their_predecessor_kept(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen = docs.columns, []
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(number)))
        docs = spark.read.parquet(str(tmp_path / str(number)))
        seen.append((name, before, docs))
        if number < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    rows = lambda df: [(r["doc_id"], r["text"]) for r in df.collect()]
    (_, a, b), (_, _, c), (_, _, d), (_, _, e), (_, _, f) = seen
    for _, text in rows(b):
        n, *_, repeated = slow_rules(text)
        assert n >= 20 and 100 * repeated <= 30 * n
    assert b.count() < a.count()
    assert sorted(rows(c), key=str) == slow_dedup(rows(b), 5)
    groups = slow_groups(rows(c))
    assert sorted(r["doc_id"] for r in d.collect()) == sorted({component for _, _, component in groups})
    leaked = {r["doc_id"] for r in decontamination.find_leaks(d, spark.read.parquet(f"{DATA}/benchmark.parquet")).collect()}
    assert {i for i, _ in rows(e)} == {i for i, _ in rows(d)} - leaked
    assert {r["doc_id"] for r in f.select("doc_id").distinct().collect()} == {i for i, _ in rows(e)}
    assert corpus_pipeline.run(spark, DATA).drop("sequence_id").exceptAll(f.drop("sequence_id")).count() == 0
    assert simhash.masks(3)
