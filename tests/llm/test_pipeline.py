"""The pipeline's stages on the smallest tables, each held against what it was given."""

import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline
from strataframe.llm import decontamination, near_dedup, quality_classifier
from strataframe.llm._spark import discard, materialize


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels, bench = spark.read.parquet(f"{sf_dir}/labels.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(materialize(stage(spark, seen[-1], sf_dir), f"test-{name}"))
    ids = [{r["doc_id"] for r in d.select("doc_id").collect()} for d in seen]
    bad = {r["doc_id"] for r in quality_classifier.score(docs, labels).where("predicted = 0").collect()}
    assert bad and ids[1] == ids[0] - bad
    copies = {r["doc_id"] for r in near_dedup.near_duplicates(seen[1]).where("not kept").collect()}
    assert copies and ids[2] == ids[1] - copies
    leaks = {r["doc_id"] for r in decontamination.leaks(seen[2], bench).collect()}
    assert leaks and ids[3] == ids[2] - leaks and ids[4] == ids[3] and ids[5] == ids[4]
    assert all(d.columns == docs.columns for d in seen[1:5])
    text = " ".join(r["text"] for r in seen[4].collect())
    assert "AKIA" not in text or "AKIA" not in " ".join(w for w in text.split() if len(w) >= 20)
    pieces = seen[5].toPandas()
    assert (pieces.groupby("doc_id").length.sum() == pieces.groupby("doc_id").doc_tokens.first()).all()
    assert corpus_pipeline.run(spark, sf_dir).count() == len(pieces)


def test_discard(spark):
    table = materialize(spark.range(3), "test-discard")
    path = table.inputFiles()[0]
    discard(spark)
    with pytest.raises(Exception, match="(?i)path|exist"):
        spark.read.parquet(path).count()


def test_stages_on_odd_rows(spark, sf_dir, tmp_path):
    """Nulls in every column, empty, white and very long texts, repeated rows and ids, columns of clashing names; then no rows at all."""
    long = " ".join(f"word{k % 977} of a text that goes on, part {k % 13}." for k in range(12_000))
    prose = "A quiet river runs along the old road. People walk there on fine days and talk about the harvest. "
    rows = [
        (1, prose * 3, "en", "a", 10), (2, prose * 3, "en", None, None), (2, prose * 3 + "x", None, "a", 1), (None, prose * 3, "en", "a", 1), (None, None, None, None, None), (3, None, "en", "a", 0), (4, "", "en", "a", 0), (5, " \n\t", "en", "a", 3),
        (6, long, "en", "a", len(long)), (7, prose + "password = hunter2hunter2 and more of it. " + prose, "en", "a", 5), (None, "Another page. token: abcdefgh12345 " + prose, "en", "b", 5), (8, "é日本 " * 50, "fr", "b", 5), (8, "é日本 " * 50, "fr", "b", 5),
    ]
    extra = "doc label spans found digest copy own key cut row value total text_ kept".split()
    docs = spark.createDataFrame([(*r, *extra) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in extra))
    ids = lambda df: sorted(str(r["doc_id"]) for r in df.select("doc_id").collect())
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = materialize(stage(spark, now, sf_dir), f"odd-{name}")
        assert after.columns == docs.columns, name
        assert all(r[c] == c for r in after.collect() for c in extra)
        left = ids(after)
        assert set(left) <= set(ids(now))
        if name == "quality_classifier":
            want = quality_classifier.score(now, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("predicted = 1")
            assert left == ids(want)
        if name == "secret_scan":
            assert left == ids(now)
            text = " ".join(r["text"] or "" for r in after.collect())
            assert "hunter2" not in text and "abcdefgh12345" not in text
            assert {r["text"] for r in after.where("doc_id = 6").collect()} <= {long}
        now = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, now, sf_dir).toPandas()
    assert (pieces.groupby(["sequence_id"]).length.sum() <= 2048).all()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
