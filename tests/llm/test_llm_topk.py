import math
import random

import pytest
from edge_cases import keep

from inspectlake.llm import topk


def brute(rows, k, every):
    best = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ints = [math.floor(1024 * x) for x in v]
            best[i] = max(best.get(i, ints), ints)
    out = set()
    for q in best:
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(best[q], best[c])), c) for c in best if c != q)
            out |= {(q, rank, c, -s) for rank, (s, c) in enumerate(scores[:k], 1)}
    return out


@pytest.mark.parametrize("blocks", [(2048, 4096), (3, 7)])
def test_against_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(topk, "QUERY_BLOCK", blocks[0])
    monkeypatch.setattr(topk, "ROW_BLOCK", blocks[1])
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(9)]) for i in range(60)]
    # Ties, repeated rows, two vectors of one id, odd vectors, other lengths.
    rows += [(i, [0.25] * 9) for i in range(100, 130)] + rows[:3] + [(7, [0.9] * 9), (200, None), (201, [None] * 9), (202, [float("nan")] * 9)]
    rows += [(203, [float("inf")] + [0.0] * 8), (None, [0.1] * 9), (205, [0.5]), (210, [])]
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int")
    vectors = keep(topk.integer_vectors(table))
    got = topk.top_k(vectors, vectors.where("vec_id % 10 = 0"), k=4)
    assert {tuple(r) for r in got.collect()} == brute(rows, 4, 10)


def test_few_rows_and_none(spark):
    table = spark.createDataFrame([(0, [1.0, 2.0]), (1, [-1.0, 1.0])], "vec_id long, embedding array<float>")
    vectors = topk.integer_vectors(table)
    assert {tuple(r) for r in topk.top_k(vectors, vectors).collect()} == {(0, 1, 1, 1048576), (1, 1, 0, 1048576)}
    none = vectors.limit(0)
    assert topk.top_k(none, none).count() == 0 and topk.top_k(vectors, none).count() == 0
