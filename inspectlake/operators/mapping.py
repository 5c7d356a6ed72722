"""Form fields matched to extracted values through an alias table."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from inspectlake import settings as S
from inspectlake.functions import text as T


def alias_table(spark, aliases=None):
    """``(norm, canonical, priority, ord, alias)``: every accepted name of a canonical one.

    The canonical name itself is number 0; ``alias`` is the name as declared.
    """
    aliases = S.FIELD_ALIASES if aliases is None else aliases
    rows = [
        (name.lower() if ord_ else name, canonical, priority, ord_, name)
        for priority, (canonical, others) in enumerate(aliases.items())
        for ord_, name in enumerate([canonical, *others])
    ]
    return spark.createDataFrame(rows, "norm string, canonical string, priority int, ord int, alias string")


def alias_join(fields, aliases):
    """Add ``canonical_name`` to every form field, null without an alias.

    One alias row per name is left, so the join never multiplies fields.  The
    alias table carries no broadcast hint: it is sent whole only while the
    optimizer knows it to be small.
    """
    first = aliases.groupBy("norm").agg(F.min_by("canonical", "priority").alias("canonical_name"))
    named = fields.withColumn("norm", T.normalize_field_name(F.col("name")))
    return named.join(first, "norm", "left")


def aliases_of(names, aliases, column="canonical_name"):
    """Add the alias list of every canonical name, as declared; empty when unknown."""
    declared = F.array_sort(F.collect_list(F.struct("ord", "alias")))
    lists = (
        aliases.filter("ord > 0")
        .groupBy(F.col("canonical").alias(column))
        .agg(F.transform(declared, lambda x: x["alias"]).alias("aliases"))
    )
    return names.join(lists, column, "left").withColumn(
        "aliases", F.coalesce("aliases", F.array().cast("array<string>"))
    )


def match_fields(fields, extracted, aliases):
    """Every form field with its canonical name, value and ``found``.

    A key that is present with a null value is found.  One join; a project
    with very many fields is split by adaptive execution.
    """
    named = alias_join(fields, aliases).drop("norm")
    values = extracted.select(
        "project_id", F.col("key").alias("canonical_name"), "value", F.lit(True).alias("found")
    )
    renamed = named.drop("value") if "value" in named.columns else named
    matched = renamed.join(values, ["project_id", "canonical_name"], "left")
    return matched.withColumn("found", F.coalesce("found", F.lit(False)))


def map_fields(fields, extracted, aliases):
    """The form fields that get a value, with their aliases, confidence and evidence."""
    named = alias_join(fields, aliases).drop("norm").filter("canonical_name is not null")
    values = extracted.select("project_id", F.col("key").alias("canonical_name"), "value")
    mapped = named.drop("value").join(values, ["project_id", "canonical_name"])
    return aliases_of(mapped, aliases).withColumn("confidence_score", F.lit(S.MAPPED_CONFIDENCE)).withColumn(
        "evidence", T.mapped_from(F.col("name"))
    )


def unmapped_fields(matched):
    """Names of the fields without a value; duplicates and order are kept."""
    return matched.filter("not found").select("project_id", "ord", "name")


def first_unmapped(matched, n=5):
    """The first ``n`` unmapped names of every project.

    The rank filter makes Spark cut each partition to ``n`` rows per project
    before the shuffle.
    """
    rank = F.row_number().over(Window.partitionBy("project_id").orderBy("ord"))
    return unmapped_fields(matched).withColumn("rn", rank).filter(F.col("rn") <= n)


def mapping_summary(matched):
    """One row per project: counts, confidence and evidence.

    The mapped and unmapped lists stay long tables; a list column would put a
    whole project into one row.
    """
    counts = matched.groupBy("project_id").agg(
        F.count_if("found").alias("n_mapped"), F.count_if(~F.col("found")).alias("n_unmapped")
    )
    return counts.withColumn("confidence_score", F.lit(S.MAPPED_CONFIDENCE)).withColumn(
        "evidence", T.mapped_count(F.col("n_mapped"))
    )


def fill_plan(matched, visible="true"):
    """What to type where: one row per project and field name.

    A name counts when one of its form fields is visible.  All fields of one
    name share a canonical name and so a value, which makes this an
    aggregation rather than a join of names with names.
    """
    plan = matched.filter("found").groupBy("project_id", "name").agg(
        F.min_by("value", "ord").alias("value"), F.bool_or(F.expr(visible)).alias("_visible")
    )
    return plan.filter("_visible").select(
        "project_id",
        "name",
        F.concat(F.lit("[name='"), F.col("name"), F.lit("']")).alias("selector"),
        F.coalesce(F.col("value").cast("string"), F.lit("None")).alias("fill_value"),
    )
