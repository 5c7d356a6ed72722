"""Exact top-k search by inner product: three phases with a uniform threshold.

A vector's components are dealt into ``SLICES`` lists, so a score is the sum of one
partial score per list.

1. Each block of rows sends, for every query, the best entries of each list with their
   totals; the k-th best total seen anywhere is the query's cutoff.
2. With the cutoff sent back, a block collects the entries whose partial score reaches
   cutoff / SLICES in some list: a total that reaches the cutoff needs one.
3. Entries whose upper bound (known parts, the threshold for the others) reaches the
   cutoff are resolved exactly; the k best of all blocks are the result.

Queries and rows meet in blocks of fixed size, ``QUERY_BLOCK`` by ``ROW_BLOCK``; the
cutoffs travel with the queries, so nothing that grows with the data is broadcast.

Defined cases: vectors that are null, or hold null or non-finite components, and null
ids take no part; of several vectors with one id the greatest in array order counts, so
repeated rows count once; vectors of unequal length are padded with zeros; equal scores
go to the smaller id; fewer than k other rows give fewer results; empty tables give an
empty result; other columns are not read.  Scores are 64-bit integers.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

SLICES = 4
QUERY_BLOCK = 2048
ROW_BLOCK = 4096
#: Rows of a block scored at a time.
STRIP = 512

_FOUND = "query_id bigint, vec_id bigint, score bigint"


def integer_vectors(rows, key="vec_id", vector="embedding", scale=1024):
    """(vec_id, ints): floor(scale * x) of every component of the usable vectors."""
    x = F.col(vector)
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    usable = rows.where(x.isNotNull() & F.col(key).isNotNull() & ~odd)
    ints = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long"))
    return usable.groupBy(F.col(key).cast("long").alias("vec_id")).agg(F.max(ints).alias("ints"))


def _matrix(column, width):
    out = np.zeros((len(column), width), dtype=np.int64)
    for k, row in enumerate(column):
        out[k, : len(row)] = row
    return out


def _lists(queries, rows):
    """Per list: the parts of the queries and rows, as numbers whose products add up exactly."""
    width = max(map(len, [*queries, *rows]), default=0)
    q, r = _matrix(queries, width), _matrix(rows, width)
    exact = width * float(np.abs(q).max(initial=0)) * float(np.abs(r).max(initial=0)) < 2**53
    q, r = (q.astype(float), r.astype(float)) if exact else (q, r)
    cuts = np.linspace(0, width, SLICES + 1).astype(int)
    return [(q[:, a:b], r[:, a:b]) for a, b in zip(cuts, cuts[1:])]


def _strips(queries, rows):
    lists = _lists(queries["asked"], rows["held"])
    for at in range(0, len(rows), STRIP):
        yield at, [q @ r[at : at + STRIP].T for q, r in lists]


def _best(found, k):
    """The k best rows of each query."""
    found = found.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
    return found.groupby("query_id", sort=False).head(k)


def _frame(query_ids, vec_ids, scores):
    return pd.DataFrame({"query_id": query_ids, "vec_id": vec_ids, "score": scores.astype(np.int64)})


def _gathered(k):
    """Phase 1 of one pair of blocks: totals of the best entries of each list."""

    def work(queries, rows):
        parts = [_frame(*np.zeros((3, 0), dtype=np.int64))]
        ids, own = rows["vec_id"].to_numpy(), queries["query_id"].to_numpy()
        for at, lists in _strips(queries, rows):
            here = ids[at : at + STRIP]
            same = own[:, None] == here[None, :]
            listed = np.zeros(same.shape, dtype=bool)
            most = min(k + 1, len(here))
            for part in lists:
                top = np.argpartition(-part, most - 1, axis=1)[:, :most]
                np.put_along_axis(listed, top, True, axis=1)
            qi, ri = np.nonzero(listed & ~same)
            parts.append(_best(_frame(own[qi], here[ri], sum(part[qi, ri] for part in lists)), k))
        return _best(pd.concat(parts), k)

    return work


def _resolved(k):
    """Phases 2 and 3 of one pair of blocks: every entry that can reach its query's cutoff, exactly."""

    def work(queries, rows):
        parts = [_frame(*np.zeros((3, 0), dtype=np.int64))]
        ids, own = rows["vec_id"].to_numpy(), queries["query_id"].to_numpy()
        cutoff = queries["cutoff"].astype(float).fillna(-np.inf).to_numpy()[:, None]
        threshold = cutoff / SLICES
        for at, lists in _strips(queries, rows):
            here = ids[at : at + STRIP]
            known = np.zeros((len(own), len(here)))
            missing = np.zeros((len(own), len(here)), dtype=np.int8)
            for part in lists:
                sent = part >= threshold
                known += np.where(sent, part, 0)
                missing += ~sent
            bound = np.where(missing > 0, known + missing * np.where(np.isfinite(threshold), threshold, 0), known)
            # Rounding of large sums may not lose an entry that just reaches the cutoff.
            able = (missing < SLICES) & (bound >= cutoff - np.abs(cutoff) * 1e-9) & (own[:, None] != here[None, :])
            qi, ri = np.nonzero(able)
            parts.append(_best(_frame(own[qi], here[ri], sum(part[qi, ri] for part in lists)), k))
        return _best(pd.concat(parts), k)

    return work


def top_k(vectors, queries, k=10, save=None):
    """(query_id, rank, vec_id, score): the k best other rows of every query.

    ``vectors`` and ``queries`` have (vec_id, ints); ``save`` writes a frame to shared
    storage and reads it back.
    """
    save = save or (lambda rows: rows)
    n_rows, n_queries = vectors.count(), queries.count()
    row_blocks, query_blocks = -(-n_rows // ROW_BLOCK) or 1, -(-n_queries // QUERY_BLOCK) or 1
    block = lambda c, n: F.pmod(F.xxhash64(F.col(c)), F.lit(n)).cast("int")
    dealt_rows = vectors.select("vec_id", F.col("ints").alias("held"), block("vec_id", row_blocks).alias("rb"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb"))
    asked = queries.select(F.col("vec_id").alias("query_id"), F.col("ints").alias("asked"), block("vec_id", query_blocks).alias("qb"))

    def meet(asked, work):
        dealt = asked.withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))))
        return dealt.groupBy("qb", "rb").cogroup(dealt_rows.groupBy("qb", "rb")).applyInPandas(work, _FOUND)

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    first = save(meet(asked, _gathered(k))).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    cutoffs = first.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("cutoff"))
    found = meet(asked.join(cutoffs, "query_id", "left"), _resolved(k))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
