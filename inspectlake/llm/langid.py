"""Language ID by word-first backoff.

A known word counts by its log frequency in each language; an unseen word falls back to
its character n-grams, the longest length first, and to the next shorter length only
where none of that length is known.  Counts come from a bounded sample of labelled
documents (``max_train`` rows, picked by a hash of the id, shared over the languages);
the tables keep the ``max_words`` most frequent words and ``max_grams`` n-grams of each
length, so the model that goes to the executors has a fixed bound.  Prediction reads
every row and whole texts.

Every language spreads ``UNSEEN`` more of each kept term over its counts, and a term it
never saw costs the same in all languages, so that one taught few words gains nothing by
what it does not know.

Defined cases: a null text or one without a letter is ``und`` with score 0, and so is
everything if nothing could be learned; a language without a word to learn from (null
texts only) is never predicted; equal scores go to the language first in code point
order; repeated rows are predicted alike; an empty table gives an empty table; other
columns are passed on unread.
"""

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from inspectlake.llm.arrays import portions
from inspectlake.llm.sampling import hash_limit

UND = "und"
#: Letters that follow each other, in any script.
_WORD = re.compile(r"[^\W\d_]+")
#: Longest word that can be a known one (longer ones are scored by their n-grams, as unseen words are), and the n-gram lengths from long to short.
KNOWN_CHARS = 24
LENGTHS = (5, 4, 3, 2, 1)
#: What is added to the count of every kept term in every language.
UNSEEN = 0.5
#: Words whose scores a worker remembers at a time.
REMEMBERED = 200_000


def sample(docs, key="doc_id", lang="lang", max_train=6_000):
    """Labelled rows outside the held-out third, at most about ``max_train``, no language favoured by its size."""
    ids = F.col(key).cast("string")
    usable = docs.where(F.col(lang).isNotNull() & F.col(key).isNotNull() & (F.crc32(ids) % 3 != 1))
    counts = {r[0]: r[1] for r in usable.groupBy(lang).count().collect()}
    each = max_train / max(1, len(counts))
    limit = F.lit(0).cast("long")
    for name, n in sorted(counts.items()):
        limit = F.when(F.col(lang) == name, F.lit(hash_limit(each, n))).otherwise(limit)
    return usable.where(F.shiftrightunsigned(F.xxhash64(ids, F.lit(3)), 1) <= limit), sorted(counts)


def _word_counts(batches):
    """Distinct lower-case words of each batch with their counts by language."""
    for batch in batches:
        found = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if text is not None:
                found.setdefault(lang, Counter()).update(_WORD.findall(text.lower()))
        for lang, words in found.items():
            words = [(w, n) for w, n in words.items() if any(c.isalpha() for c in w)]
            if words:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(words)), pa.array([w for w, _ in words]), pa.array([n for _, n in words], pa.int64())],
                    names=["lang", "word", "n"],
                )


def _most(counts, most):
    """The ``most`` terms with the highest total count, ties by the term, with a count per language."""
    total = counts.groupBy("term").agg(F.sum("n").alias("total"), F.collect_list(F.struct("lang", "n")).alias("by"))
    return total.orderBy(F.desc("total"), "term").limit(most).collect()


def fit(docs, key="doc_id", text="text", lang="lang", max_train=6_000, max_words=60_000, max_grams=20_000, save=None):
    """The model: languages, log frequencies of words and of n-grams by length."""
    rows, _ = sample(docs, key, lang, max_train)
    words = rows.select(F.col(lang).alias("lang"), F.col(text).alias("text")).mapInArrow(_word_counts, "lang string, word string, n bigint")
    words = words.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = save(words) if save else words
    short = F.length("word") <= KNOWN_CHARS
    names = sorted(r[0] for r in words.where(short).select("lang").distinct().collect())
    place = {name: k for k, name in enumerate(names)}

    def table(counts, most):
        kept = _most(counts, most)
        if not kept:
            return {}
        totals = np.full(len(names), UNSEEN * len(kept))
        for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect():
            totals[place[r.lang]] += r.n
        floor = np.log(UNSEEN / totals.max())
        logs = {}
        for r in kept:
            row = np.zeros(len(names))
            for x in r.by:
                row[place[x.lang]] += x.n
            logs[r.term] = np.where(row > 0, np.log((row + UNSEEN) / totals), floor)
        return logs

    model = {"langs": names, "words": table(words.where(short).select("lang", F.col("word").alias("term"), "n"), max_words), "grams": {}}
    edged = words.where(short).withColumn("edged", F.concat(F.lit("<"), "word", F.lit(">")))
    for length in LENGTHS:
        grams = edged.where(F.length("edged") >= length).select(
            "lang", "n", F.explode(F.transform(F.sequence(F.lit(1), F.length("edged") - (length - 1)), lambda k: F.col("edged").substr(k, F.lit(length)))).alias("term")
        )
        model["grams"][length] = table(grams.groupBy("lang", "term").agg(F.sum("n").alias("n")), max_grams)
    return model


class Scorer:
    def __init__(self, model):
        self.model = model
        self.known = dict(model["words"])
        self.seen = {}
        self.none = np.zeros(len(model["langs"]))

    def backoff(self, word):
        """Mean log frequency of the word's n-grams, of the longest length that has a known one."""
        edged = f"<{word}>"
        for length in LENGTHS:
            table = self.model["grams"][length]
            rows = [table[g] for k in range(len(edged) - length + 1) if (g := edged[k : k + length]) in table]
            if rows:
                return np.mean(rows, axis=0)
        return self.none

    def word(self, word):
        row = self.known.get(word)
        if row is not None:
            return row
        row = self.seen.get(word)
        if row is None:
            row = self.backoff(word)
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            if len(word) <= 2 * KNOWN_CHARS:
                self.seen[word] = row
        return row

    def predict(self, text):
        if text is None:
            return UND, 0.0
        words = Counter(_WORD.findall(text.lower()))
        if not self.model["langs"] or not any(c.isalpha() for w in words for c in w):
            return UND, 0.0
        rows = np.array([self.word(w) for w in words])
        total = np.fromiter(words.values(), dtype=float, count=len(words)) @ rows
        best = int(np.argmax(total))
        return self.model["langs"][best], float(1 / np.exp(np.clip(total - total[best], -700, 0)).sum())


def lang_udf(spark, model):
    """A column function from text to (lang, score)."""
    shared = spark.sparkContext.broadcast(model)

    def predict(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(shared.value)
        for column in columns:
            found = [scorer.predict(t) for part in portions(column) for t in part.to_pylist()]
            yield pa.StructArray.from_arrays(
                [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["lang", "score"]
            )

    return F.arrow_udf("lang string, score double")(predict)


def with_language(docs, model, text="text", to="language"):
    """The rows with a struct (lang, score) of their whole text in the column ``to``."""
    return docs.withColumn(to, lang_udf(docs.sparkSession, model)(F.col(text)))
