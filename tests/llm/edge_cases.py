"""Rows that every operation has to take, and helpers."""

import re

from inspectlake.session import saved

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"word{k % 977} of{k % 13}" for k in range(30_000))
TEXTS = [
    (1, None, "en", "a"),
    (2, "", "en", "a"),
    (3, " \t\n", None, None),
    (4, "Short text.", "en", "b"),
    (5, "Twice the same row, twice.", "en", "b"),
    (5, "Twice the same row, twice.", "en", "b"),
    (None, "A row without an id but with words.", "fr", "b"),
    (6, LONG, "en", "c"),
    (7, "Ünïcödé 日本語 \U0001f600 text\nwith two\nwith two\n\nlines", "de", None),
]


def edge_docs(spark):
    """The rows above, with columns named like results."""
    rows = [(i, t, lang, source, 0, 0.5, "x", 1, ["y"]) for i, t, lang, source in TEXTS]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_words long, score double, path string, copies long, finds array<string>"
    )


def no_docs(spark):
    return edge_docs(spark).limit(0)


def keep(rows):
    return saved(rows, "llm-test")


def words(text):
    return WORD.findall(text or "")


def shingles(text, width=5):
    w = words(text)
    if len(w) < width:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1))
