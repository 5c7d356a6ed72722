"""From raw documents to token ids: five stages, each one operation of ``inspectlake.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``docs``.  ``run`` applies them in order, each result written to
shared storage and read back.

Defined cases, for every stage: null columns, empty and very long texts, repeated rows,
empty tables and further columns (dots in their names too) are allowed; names that begin with an underscore are the stages' own.  Rows with a null id are never dropped as
repeats.  ``n_chars``, where the table has it, follows the text.
"""

import functools

import public_tokenizers
from pyspark.sql import Window
from pyspark.sql import functions as F

from inspectlake.llm import bpe, jaccard, lines, mixing, quality
from inspectlake.session import saved, ship_package

#: The stages draw at random and compare near texts: SQL cannot express them.
ORACLE_SQL = None


def _saver(name):
    return lambda rows: saved(rows, name)


def _columns(docs):
    """The columns of the table, also those with dots in their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def _shipped(stage):
    @functools.wraps(stage)
    def run_stage(spark, docs, sf_dir):
        ship_package(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


@_shipped
def good_documents(spark, docs, sf_dir):
    """Documents whose quality score is 0.5 or more; the score itself is not kept."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels, save=_saver("quality"))
    return quality.with_quality(docs, model, to="_quality_score").where("_quality_score >= 0.5").select(*_columns(docs))


@_shipped
def fresh_lines(spark, docs, sf_dir):
    """All documents, without the lines that an earlier document or place has."""
    rows = lines.dedup_lines(docs, _saver("lines"), counts=("_n_lines", "_n_dropped"))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("_n_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rows.select(*_columns(docs))


@_shipped
def one_of_each_group(spark, docs, sf_dir):
    """The document with the least id of every group of near copies; rows with one id are one document."""
    found = jaccard.jaccard_join(docs.select("doc_id", "text"), _saver("jaccard"))
    later = found.where("doc_id <> group_id").select(F.col("doc_id").alias("_later"))
    rows = docs.join(later, F.col("doc_id").cast("long") == F.col("_later"), "left_anti")
    repeated = saved(docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("_twice")).count().where("count > 1").select("_twice"), "repeated")
    same = F.col("doc_id") == F.col("_twice")
    first = Window.partitionBy("doc_id").orderBy(*[c for c, f in zip(_columns(docs), docs.schema) if f.name != "doc_id" and f.dataType.typeName() in ("string", "long", "integer", "double")])
    of_repeated = rows.join(repeated, same, "left_semi").withColumn("_place", F.row_number().over(first)).where("_place = 1")
    return rows.join(repeated, same, "left_anti").select(*_columns(docs)).unionByName(of_repeated.select(*_columns(docs)))


@_shipped
def mixed_sources(spark, docs, sf_dir):
    """Every document as often as the mix takes it: not at all, once or twice."""
    size = mixing.word_count(F.col("text"))
    mixed = mixing.mix(docs.select("doc_id", "source", size.alias("size")), save=_saver("mixing"))
    taken = mixed.where("copies > 0").select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_taken_size"), F.col("copies").cast("int").alias("_copies"))
    rows = docs.withColumn("_size", size).join(
        taken,
        F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("_size") == F.col("_taken_size")),
    )
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*_columns(docs))


@_shipped
def token_ids(spark, docs, sf_dir):
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256) of every row."""
    return bpe.encode(
        docs,
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        columns=("n_tokens", "ids", "ids_sha256", "decoded_sha256"),
        pattern=public_tokenizers.PATTERN,
    )


STAGES = [
    ("quality_classifier", good_documents),
    ("line_dedup", fresh_lines),
    ("ngram_jaccard_join", one_of_each_group),
    ("mix_sources", mixed_sources),
    ("byte_bpe", token_ids),
]


def run(spark, sf_dir):
    """The token ids of the documents that are left, read from shared storage."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        rows = saved(stage(spark, rows, sf_dir), name)
    return rows
