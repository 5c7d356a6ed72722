"""Quality rules as a short-circuit cascade (DataFrame functions only).

``with_counts`` adds the counts of a whole text, ``plan`` measures every rule's cost and
selectivity on a bounded sample and orders the rules by rejections per second, and
``cascade`` applies them in that order: a later rule is worked out only for rows that
the earlier ones kept.  The order changes the cost and which failed rule is named, never
which rows are kept.

Defined cases: a null text has no words, lines or characters and fails ``few_words``;
repeated rows are judged alike; an empty table gives an empty table (and the rules in
their given order); other columns are passed on, except that columns named like the
counts are replaced.
"""

import time

from pyspark.sql import functions as F

from inspectlake.llm.sampling import within

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Rows of the sample that rules are measured on, about.
SAMPLE_ROWS = 2_000

COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def _let(value, use):
    """``use(value)`` with the value worked out once."""
    return F.transform(F.array(value), use)[0]


def _removed(text, chars):
    """How many characters of the text are among ``chars``."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def words_of(text):
    ink = F.trim(text, F.lit(BLANKS))
    return F.when(ink == "", F.array().cast("array<string>")).otherwise(F.split(ink, r"[\x20\x09-\x0D]+"))


def _pairs(hashes, apart):
    """Hash of each entry with the one ``apart`` places on."""
    size = F.greatest(F.lit(0), F.size(hashes) - apart)
    return F.transform(F.slice(hashes, F.lit(1), size), lambda x, i: F.xxhash64(x, F.get(hashes, i + apart)))


def _covered(windows):
    """Positions covered by windows that occur twice or more."""

    def of_sorted(s):
        twice = F.filter(s, lambda x, i: F.get(s, i - 1)["h"].eqNullSafe(x["h"]) | F.get(s, i + 1)["h"].eqNullSafe(x["h"]))
        places = F.array_sort(F.transform(twice, lambda x: x["at"]))
        steps = lambda p: F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW))))
        return F.aggregate(_let(places, steps), F.lit(0), lambda total, x: total + x)

    return _let(F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.alias("at")))), of_sorted)


def repeat_words(words):
    """Words that lie in an eight-word window found twice or more in the text.

    Windows are compared by 64-bit hashes built by doubling (1, 2, 4, 8 words).
    """

    def of_windows(w):
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(_covered(w))

    return _let(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda h1: _let(_pairs(h1, 1), lambda h2: _let(_pairs(h2, 2), lambda h4: _let(_pairs(h4, 4), of_windows))),
    )


def with_counts(docs, text="text"):
    """The rows with the columns ``COUNTS`` of their whole text."""
    clean = F.coalesce(F.col(text), F.lit(""))
    rows = docs.drop(*COUNTS).withColumns({"_words": words_of(clean), "_lines": F.filter(F.split(clean, "\n"), lambda x: F.trim(x, F.lit(BLANKS)) != "")})
    return rows.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": (F.length(clean) - _removed(clean, BLANKS)).cast("long"),
            "n_symbols": _removed(clean, SYMBOLS).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": repeat_words(F.col("_words")).cast("long"),
        }
    ).drop("_words", "_lines")


#: Rules of the base verdict: true where a row fails.
BASE_RULES = {
    "few_words": lambda text: F.col("n_words") < 20,
    "repeat_words": lambda text: 100 * F.col("n_repeat_words") > 30 * F.col("n_words"),
}
#: Further rules: true where a row fails.
MORE_RULES = {
    "short_words": lambda text: F.col("word_chars") < 2 * F.col("n_words"),
    "long_words": lambda text: F.col("word_chars") > 15 * F.col("n_words"),
    "symbols": lambda text: 100 * F.col("n_symbols") > 30 * F.col("n_words"),
    "dup_lines": lambda text: 100 * F.col("n_dup_lines") > 40 * F.col("n_lines"),
    "shouting": lambda text: 2 * _removed(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ") > F.col("word_chars"),
    "exclamations": lambda text: 100 * _removed(F.col(text), "!") > 50 * F.col("n_words"),
    "no_letters": lambda text: 2 * F.regexp_count(F.col(text), F.lit(r"\p{L}[^\x20\x09-\x0D]*")) < F.col("n_words"),
}


def sample_of(docs, text="text", rows=SAMPLE_ROWS):
    """About ``rows`` rows, picked by a hash of the text, so reruns pick the same."""
    return docs.where(within(F.xxhash64(F.col(text)), rows, docs.count()))


def plan(sample, rules, text="text"):
    """(name, rejected share, seconds) of every rule, the highest rejection per second first."""
    measured = []
    total = max(1, sample.count())
    for name, rule in rules.items():
        start = time.perf_counter()
        failed = sample.agg(F.count_if(rule(text))).first()[0]
        measured.append((name, failed / total, time.perf_counter() - start))
    return sorted(measured, key=lambda m: -m[1] / m[2])


def cascade(rows, rules, order, text="text", to="failed_rule"):
    """The rows with the name of the first rule, in ``order``, that they fail (null: none)."""
    verdict = F.lit(None).cast("string")
    for name in reversed(order):
        verdict = F.when(F.coalesce(rules[name](text), F.lit(False)), F.lit(name)).otherwise(verdict)
    return rows.withColumn(to, verdict)
