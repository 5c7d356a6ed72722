import os

import pytest
from edge_cases import TEXTS, edge_docs, keep, no_docs, shingles
from pyspark.sql import functions as F

import corpus_pipeline as P

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def labels_dir(spark, tmp_path_factory):
    """A folder with labels of its own, without any usable row."""
    path = str(tmp_path_factory.mktemp("labels"))
    spark.createDataFrame([(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(os.path.join(path, "labels.parquet"))
    return path


def test_stages_on_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs.columns
    rows = docs
    for name, stage in P.STAGES:
        before, rows = rows, keep(stage(spark, rows, SF))
        old, new = before.collect(), rows.collect()
        if name != P.STAGES[-1][0]:
            assert rows.columns == first and rows.dtypes == docs.dtypes
        if name in ("quality_classifier", "ngram_jaccard_join"):
            assert set(new) <= set(old) and len(new) > 0.7 * len(old)
        if name == "line_dedup":
            assert len(new) == len(old) and all(len(r.text) == r.n_chars for r in new)
            kept = [x for r in new for x in r.text.split("\n") if x.strip()]
            assert len(kept) == len(set(kept))
        if name == "ngram_jaccard_join":
            sets = [shingles(r.text) for r in new]
            assert len(sets) == len(set(sets))
            gone = {r.doc_id for r in old} - {r.doc_id for r in new}
            for r in old:
                if r.doc_id in gone:
                    a = shingles(r.text)
                    assert any(a == b or 5 * len(a & b) >= 4 * len(a | b) for b in map(shingles, [x.text for x in old if x.doc_id != r.doc_id]))
        if name == "mix_sources":
            taken = sum(len(r.text.split()) for r in new)
            assert taken == pytest.approx(1.5 * sum(len(r.text.split()) for r in old), rel=0.1)
    assert rows.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]


def test_edge_rows_and_no_rows(spark, labels_dir):
    for make in (edge_docs, no_docs):
        rows = make(spark)
        for name, stage in P.STAGES:
            before, rows = rows.count(), keep(stage(spark, rows, labels_dir))
            if name in ("quality_classifier", "line_dedup"):
                assert rows.count() == before
            if name == "ngram_jaccard_join" and before:
                ids = [r.doc_id for r in rows.collect()]
                # The null id stays; empty texts are one group; the repeated row is one.
                assert sorted(map(str, ids)) == sorted(map(str, [1, 4, 5, 6, 7, None]))
    assert len(TEXTS) == 9


def test_names_with_dots(spark, labels_dir):
    rows = edge_docs(spark).withColumn("a.b", F.col("score")).withColumn("c`d.e", F.lit("x"))
    for name, stage in P.STAGES[:-1]:
        after = stage(spark, rows, labels_dir)
        assert after.dtypes == rows.dtypes and after.count() > 0, name


def test_run(spark):
    assert P.run(spark, SF).count() > 100
