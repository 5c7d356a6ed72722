"""Mixing sources to target weights by pivotal dependent rounding (DataFrame functions only).

Every document of a source should be taken ``target / source_size`` times.  The whole
part is taken outright; the fractional parts are rounded in pairs: mass (fraction times
size) moves between two documents, in a random direction with the odds that keep each
document's expectation, until one fraction is 0 or 1.  A source's sum of sizes stays as
it was in every step, so what remains is one open document per bucket; the open
documents of the buckets meet in the next round of a reduction tree, until one is left,
which a last draw decides.  Taken words miss a target by less than one document.

Buckets hold about ``bucket`` documents whatever a source's size, so a source with most
rows is spread over as many tasks as it needs.  Draws are hashes of (seed, id), so
reruns agree.

Defined cases: the null source is a source of its own, last in order; a null or empty
text has size 0, and its copies are the whole part only; rows that agree in id, source
and size are one item and get the same number of copies; an empty table gives an empty
table; other columns are not read.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
BUCKET = 128
#: Nearer to 0 or 1 than this, a fraction counts as whole.
NEAR = 1e-9


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes, share=1.5, most=2.0, weights=WEIGHTS):
    """(source, source_size, target) out of rows of (source, size).

    ``share`` of all sizes goes to the sources by weight; a source's target stops at
    ``most`` times its size and the excess goes to the others by weight: the target is
    ``min(most * size, level * weight)`` for the one level that uses the share up.  One
    row per source is all that meets in one window.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    every = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*map(F.lit, weights))
    totals = totals.withColumn("_w", cycle[((F.row_number().over(every) - 1) % len(weights)).cast("int")].cast("double"))
    totals = totals.withColumn("_cap", F.lit(float(most)) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    below = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = totals.select(
        "*",
        (F.lit(float(share)) * F.sum("source_size").over(whole)).alias("_all"),
        F.coalesce(F.sum("_cap").over(below), F.lit(0.0)).alias("_full"),
        (F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(below), F.lit(0.0))).alias("_open"),
    )
    # The level if this source and all with a higher ratio stay below their caps; capping more than it needs lowers it.
    level = (F.col("_all") - F.col("_full")) / F.col("_open")
    totals = totals.withColumn("_level", F.when(level * F.col("_w") <= F.col("_cap"), level))
    totals = totals.withColumn("_level", F.max("_level").over(whole))
    target = F.least(F.col("_cap"), F.coalesce(F.col("_level") * F.col("_w"), F.col("_cap")))
    return totals.select("source", "source_size", target.alias("target"))


def _uniform(*parts):
    """A number in [0, 1) from a hash of the parts."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 40)).cast("double") / F.lit(float(1 << 40))


def _whole(p):
    return (p <= NEAR) | (p >= 1 - NEAR)


def _meet(state, item):
    """One pairing: the open document of ``state`` and the next one; one of them gets settled."""
    i = state["open"]
    into_i = F.least((1 - i["p"]) * i["weight"], item["p"] * item["weight"])
    out_of_i = F.least(i["p"] * i["weight"], (1 - item["p"]) * item["weight"])
    gain = F.when(item["u"] * (into_i + out_of_i) < out_of_i, into_i).otherwise(-out_of_i)
    pi, pj = i["p"] + gain / i["weight"], item["p"] - gain / item["weight"]

    def with_p(x, p):
        return F.struct(x["id"].alias("id"), x["n"].alias("n"), x["size"].alias("size"), x["weight"].alias("weight"), p.alias("p"), x["u"].alias("u"))

    done_i = _whole(pi)
    settled = F.when(done_i, with_p(i, F.round(pi))).otherwise(with_p(item, F.round(pj)))
    still = F.when(done_i, with_p(item, pj)).otherwise(with_p(i, pi))
    met = F.struct(still.alias("open"), F.array_append(state["done"], settled).alias("done"))
    return F.when(i["weight"].isNull(), F.struct(item.alias("open"), state["done"].alias("done"))).otherwise(met)


def _round(rows, level, seed):
    """Settles all but one document of each (source, bucket): rows of ``state``."""
    item = F.struct("id", "n", "size", "weight", "p", _uniform(F.lit(seed), F.lit(level), F.col("id").cast("string"), "size", "weight").alias("u"))
    # Like sizes meet, the large ones first: the document left open at the end tends to be a small one.
    groups = rows.groupBy("source", "whole", "bucket").agg(F.sort_array(F.collect_list(F.struct("size", F.col("id").cast("string").alias("tie"), item.alias("item"))), asc=False).alias("items"))
    items = F.transform("items", lambda x: x["item"])
    kind = rows.schema["id"].dataType.simpleString()
    shape = f"struct<id: {kind}, n: bigint, size: bigint, weight: double, p: double, u: double>"
    start = F.struct(F.lit(None).cast(shape).alias("open"), F.array().cast(f"array<{shape}>").alias("done"))
    return groups.select("source", "whole", "bucket", F.aggregate(items, start, _meet).alias("state"))


def mix(sizes, share=1.5, most=2.0, weights=WEIGHTS, bucket=BUCKET, seed=29, save=None):
    """``copies`` of every item: (doc_id, source, size, n, source_size, target, copies).

    ``sizes`` has doc_id, source, size (words); ``n`` counts equal rows.  ``save``
    writes a frame to shared storage and reads it back, between rounds.
    """
    save = save or (lambda rows: rows)
    items = save(sizes.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")))
    targets = source_targets(items.select("source", (F.col("size") * F.col("n")).alias("size")), share, most, weights)
    targets = targets.join(
        items.where("size > 0").groupBy(F.col("source").alias("_source")).agg(F.count("*").alias("_items")), F.col("source").eqNullSafe(F.col("_source")), "left"
    ).drop("_source")
    targets = save(targets.select("*", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("_times")))
    # One row per source, saved: Spark knows its size and sends it to all tasks only if it is small.
    named = targets.withColumnRenamed("source", "_s")
    every = items.join(named, F.col("source").eqNullSafe(F.col("_s")))
    every = every.withColumn("whole", F.floor(F.col("_times") + NEAR)).withColumn("p", F.greatest(F.lit(0.0), F.col("_times") - F.col("whole")))
    buckets = F.greatest(F.lit(1), F.ceil(F.col("_items") / bucket))
    open_rows = every.where(F.col("size") > 0).select(
        "source", "whole", F.col("doc_id").alias("id"), "n", "size", (F.col("size") * F.col("n")).cast("double").alias("weight"), "p",
        F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), "size"), buckets).alias("bucket"),
    )
    largest = items.where("size > 0").groupBy("source").count().agg(F.max("count")).first()[0] or 0
    settled, left, level = [], largest, 0
    while True:
        states = save(_round(open_rows, level, seed))
        settled.append(states.select("source", "whole", F.explode("state.done").alias("x")))
        rest = states.select("source", "whole", "bucket", F.col("state.open").alias("x"))
        if left <= bucket:
            break
        # Bucket counts vary around their mean; the next tree level has a fixed fan-in of buckets.
        left = -(-left // bucket)
        open_rows = rest.select(
            "source", "whole", "x.id", "x.n", "x.size", "x.weight", "x.p", F.floor(F.col("bucket") / bucket).alias("bucket")
        )
        level += 1
    last = F.col("x").withField("p", F.when(_uniform(F.lit(seed), F.lit("last"), F.col("x.id").cast("string")) < F.col("x.p") - NEAR, 1.0).otherwise(0.0))
    found = rest.select("source", "whole", last.alias("x"))
    for part in settled:
        found = found.unionByName(part)
    found = found.select(F.col("x.id").alias("doc_id"), "source", F.col("x.size").alias("size"), F.col("x.n").alias("n"), (F.col("whole") + F.col("x.p")).cast("long").alias("copies"))
    empty = every.where(F.col("size") == 0).select("doc_id", "source", "size", "n", F.col("whole").cast("long").alias("copies"))
    return (
        found.unionByName(empty)
        .join(named.select("_s", "source_size", "target"), F.col("source").eqNullSafe(F.col("_s")))
        .select("doc_id", "source", "size", "n", "source_size", "target", "copies")
    )
