"""Jaccard join, line dedup, components and mixing against brute force."""

import itertools
import random

import pyarrow as pa
import pytest
from edge_cases import LONG, TEXTS, edge_docs, keep, no_docs, shingles, words
from pyspark.sql import functions as F

from inspectlake.llm import jaccard, lines, mixing
from inspectlake.llm.components import components


def brute_join(rows):
    """rows: id to text, unique ids.  id to (class, group, links, copies)."""
    sets = {i: shingles(t) for i, t in rows.items()}
    reps = {}
    for i in sorted(sets):
        reps.setdefault(sets[i], i)
    links = {i: set() for i in reps.values()}
    for (a, i), (b, j) in itertools.combinations([(s, i) for s, i in reps.items() if s], 2):
        if 5 * len(a & b) >= 4 * len(a | b):
            links[i].add(j)
            links[j].add(i)
    group = {}
    for start in sorted(links):
        front = [start] if start not in group else []
        while front:
            x = front.pop()
            if x not in group:
                group[x] = start
                front += links[x]
    copies = {c: sum(reps[s] == c for s in sets.values()) for c in links}
    return {i: (reps[s], group[reps[s]], len(links[reps[s]]), copies[reps[s]]) for i, s in sets.items()}


def near_copies(rng, n):
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    for _ in range(n):
        text = list(base)
        for _ in range(rng.randrange(4)):
            text[rng.randrange(len(text))] = f"v{rng.randrange(10**6)}"
        yield " ".join(text)


@pytest.mark.parametrize("block", [None, 8])
def test_join_against_brute_force(spark, monkeypatch, block):
    if block:
        # Every bucket and cluster of note is then dealt over pairs of blocks.
        monkeypatch.setattr(jaccard, "BUCKET", block)
        monkeypatch.setattr(jaccard, "BLOCK_MEMBERS", block)
    rng = random.Random(11)
    texts = [*near_copies(rng, 40), *near_copies(rng, 3), *["same words here and there again"] * 5, "", None, " \n", "one two", "one  two", LONG, LONG + " end"]
    texts += [" ".join(f"u{rng.randrange(50)}" for _ in range(30)) for _ in range(30)]
    rows = dict(enumerate(rng.sample(texts, len(texts)), 1))
    table = spark.createDataFrame([*rows.items(), (None, "no id"), (1, rows[1])], "doc_id long, text string")
    got = jaccard.jaccard_join(table, keep).collect()
    assert {r.doc_id: (r.class_id, r.group_id, r.n_links, r.n_copies) for r in got} == brute_join(rows) and len(got) == len(rows)


def test_join_edge_rows(spark):
    got = {r.doc_id: r for r in jaccard.jaccard_join(edge_docs(spark), keep).collect()}
    assert set(got) == {t[0] for t in TEXTS} - {None}
    assert got[2].class_id == got[3].class_id == got[1].class_id == 1 and all(r.n_links == 0 for r in got.values())
    assert jaccard.jaccard_join(no_docs(spark), keep).count() == 0


def test_runs_reach_the_recall():
    assert jaccard.runs_for(0.9) <= jaccard.runs_for(0.9999) == 4


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 5000), (5000, 200), (7, 7), (3, 1), (3, 1)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long"), keep).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 200: 100, 5000: 100}
    assert components(spark.createDataFrame([], "a long, b long"), keep).count() == 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (c != d)))
        row = new
    return row[-1]


def changed(rng, text, n):
    text = list(text)
    for _ in range(n):
        k = rng.randrange(len(text) + 1)
        text[k : k + 1] = rng.choice([[], ["ö"], [*text[k : k + 1], "é"]])
    return "".join(text)


def test_banded_distance():
    rng = random.Random(2)
    for _ in range(5000):
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(10)))
        b = changed(rng, a, rng.randrange(4)) if a else "b" * rng.randrange(4)
        for limit in range(4):
            assert lines.within(a, b, limit) == (edits(a, b) <= limit)


@pytest.mark.parametrize("size", [1, 2, 3, 100])
def test_shared_keys_over_batches(size):
    rng = random.Random(6)
    rows = sorted(((rng.randrange(9), rng.randrange(4), rng.random() < 0.5) for _ in range(60)), key=lambda r: (r[0], r[1], not r[2]))
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[k : k + size])], schema=lines._KEY) for k in range(0, len(rows), size)]
    got = [tuple(r.values()) for b in lines._shared_keys(batches) for r in b.to_pylist()]
    by_key = {}
    for key, h, index in rows:
        by_key.setdefault(key, {}).setdefault(h, index)
    assert got == [(k, h, i) for k, hs in by_key.items() if len(hs) > 1 for h, i in hs.items()]


def test_a_line_that_repeats_itself_stays_an_index(spark):
    rows = [(1, "a" * 30), (2, "a" * 31), (3, "ab" * 15), (4, "ab" * 15 + "a")]
    got = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), keep).collect()}
    assert got == {1: "a" * 30, 2: "", 3: "ab" * 15, 4: ""}


@pytest.mark.parametrize("block", [256, 2])
def test_lines_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(lines, "BLOCK", block)
    rng = random.Random(4)
    bases = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(18, 60))) + "." for _ in range(25)]
    pool = bases + [changed(rng, b, rng.randrange(5)) for b in bases * 8] + ["", " ", "short", "same first part of a line and then " + "x" * 20]
    docs = {i: "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 9))) for i in range(120)}
    table = spark.createDataFrame([*docs.items(), (5, docs[5]), (None, docs[3]), (999, None)], "doc_id long, text string")
    first = {}
    for i in sorted(docs):
        for k, line in enumerate(docs[i].split("\n")):
            if words(line):
                first.setdefault(line, (i, k))
    near = {x for x in first if len(x) >= lines.SHORTEST for y in first if first[y] < first[x] and len(y) >= lines.SHORTEST and edits(x, y) <= lines.THRESHOLD}
    assert len(near) > 20
    got = lines.dedup_lines(table, keep).collect()
    assert len(got) == len(docs) + 3
    for r in got:
        if r.doc_id is None:
            assert (r.text, r.n_dropped) == (docs[3], 0)
        elif r.doc_id == 999:
            assert (r.text, r.n_lines) == (None, 0)
        else:
            parts = docs[r.doc_id].split("\n")
            kept = [x for k, x in enumerate(parts) if not words(x) or (first[x] == (r.doc_id, k) and x not in near)]
            assert r.text == "\n".join(kept)
            assert (r.n_lines, r.n_dropped) == (sum(bool(words(x)) for x in parts), len(parts) - len(kept))


def test_lines_edge_rows(spark):
    got = lines.dedup_lines(edge_docs(spark), keep).select("doc_id", "text", "n_dropped", "score").collect()
    assert len(got) == len(TEXTS)
    by_id = {r.doc_id: r for r in got}
    assert by_id[7].text == "Ünïcödé 日本語 \U0001f600 text\nwith two\n\nlines" and by_id[7].n_dropped == 1
    assert by_id[1].text is None and by_id[5].n_dropped == 0 and by_id[6].text == LONG
    assert lines.dedup_lines(no_docs(spark), keep).count() == 0


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    full = set()
    while True:
        left = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in full)
        rest = sum(weight[s] for s in names if s not in full)
        target = {s: 2 * sizes[s] if s in full else left * weight[s] / rest for s in names}
        more = {s for s in names if s not in full and target[s] > 2 * sizes[s]}
        if not more:
            return target
        full |= more


@pytest.mark.parametrize("bucket", [128, 6])
def test_mixing(spark, bucket):
    rng = random.Random(8)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", "ü", None]), rng.choice([0, 1, 5, 40, 300])) for i in range(900)]
    rows += [rows[0], (None, "a", 7)]
    table = spark.createDataFrame(rows, "doc_id long, source string, size long")
    got = mixing.mix(table, bucket=bucket, save=keep).collect()
    assert sum(r.n for r in got) == len(rows)
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    want = brute_targets(sizes)
    for s in sizes:
        own = [r for r in got if r.source == s]
        assert own[0].source_size == sizes[s] and own[0].target == pytest.approx(want[s])
        assert abs(sum(r.copies * r.size * r.n for r in own) - want[s]) <= 600
    assert all(0 <= r.copies <= 2 for r in got)
    again = mixing.mix(table.repartition(3), bucket=bucket).collect()
    assert {(r.doc_id, r.source, r.size): r.copies for r in got} == {(r.doc_id, r.source, r.size): r.copies for r in again}


def test_mixing_edges(spark):
    sizes = edge_docs(spark).select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    got = mixing.mix(sizes).collect()
    assert sum(r.n for r in got) == len(TEXTS)
    assert mixing.mix(sizes.limit(0)).count() == 0
    empty = spark.createDataFrame([(1, "a", 0), (2, None, 0)], "doc_id long, source string, size long")
    assert [r.copies for r in mixing.mix(empty).collect()] == [0, 0]
