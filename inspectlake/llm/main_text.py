"""Main text of web pages: boosted trees over the nodes of a page, decoded as a tree.

Every block of a page gets features (subtree density, attribute tokens, depth, siblings,
links, place) and from gradient-boosted trees the log-probabilities of three states: out,
in, and both (a container of text of either kind).  The states of all nodes are then chosen
together, so that nothing below an excluded block comes back and no block of the article
loses its container.

The tables hold no labels, so the trees learn from pages whose parts are known by
construction: up to ``max_pages`` pages, picked by a hash of their content, lend their words to
drawn layouts (``layouts.py``), and the page itself teaches too if exactly one landmark
element (article or main) says where its article is.  At most ``max_nodes`` nodes of a
page are taken.  Every page is then extracted, and whole.

The text: character references are decoded, white space inside a block becomes one blank,
blocks are trimmed and joined by an empty line, in the order of the page.  Texts of scripts,
styles, buttons, selections and other elements that are not shown as text are never read.

Defined cases: a null or empty html has an empty text; repeated rows give repeated rows;
null ids and urls are kept; broken, unclosed or very deep markup is read as far as it goes;
an empty table gives an empty table, and so does one without any block to learn from (empty
texts); other columns are not read.
"""

import collections

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from inspectlake.llm import boosting
from inspectlake.llm.arrays import portions
from inspectlake.llm.dom import TAGS, Forest
from inspectlake.llm.layouts import drawn_pages
from inspectlake.llm.sampling import within

OUT, IN, BOTH = 0, 1, 2
#: Attribute tokens with a learned score: the most frequent ones, on so many pages at least.
MOST_TOKENS = 3_000
LEAST_PAGES = 3
#: Nodes whose features are held at a time.
NODES = 20_000
_LANDMARKS = {TAGS["article"], TAGS["main"]}
_AROUND = {TAGS[t] for t in ("nav", "aside", "footer", "form", "dialog")}


def sample_of(pages, max_pages, html="html"):
    """The html of at most ``max_pages`` different pages, picked by a hash of their content."""
    rows = pages.select(F.col(f"`{html}`").alias("html")).where("html <> ''").withColumn("h", F.xxhash64("html"))
    # Enough rows for the sample even if most are copies of others; then exactly as many as wanted.
    few = rows.where(within(F.col("h"), 64 * max_pages, pages.count())).groupBy("h").agg(F.first("html").alias("html"))
    return few.orderBy("h").limit(max_pages)


def _marked(forest, landmarks):
    """Mark the single landmark of the page, and what HTML's own elements put beside it."""
    found = [i for i, t in enumerate(forest.tag) if t in _LANDMARKS]
    if not landmarks or len(found) != 1:
        return False
    forest.mark[found[0]] = "main"
    for i, t in enumerate(forest.tag):
        if t in _AROUND and not any(forest.mark[k] == "other" for k in (forest.parent[i],)):
            forest.mark[i] = "other"
    return True


def _training_forests(batches, layouts):
    """One forest of marked pages for each page of the sample."""
    for batch in batches:
        for h, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = Forest()
            own.add(html)
            words = [w for t in own.text for w in t.split()]
            forest = Forest()
            if own.arrays().n and _marked(own, True):
                yield h, own
            for page in drawn_pages(h, words, layouts):
                forest.add(page)
            yield h, forest


def _token_counts(sample, layouts):
    """(token, n_in, n_out, n): nodes of each state that carry the token."""

    def work(batches):
        counts = collections.Counter()
        for _, forest in _training_forests(batches, layouts):
            for tokens, state in zip(forest.tokens, forest.arrays().labels()):
                for token in tokens:
                    counts[token, int(state)] += 1
        rows = [{"token": t, "state": s, "n": n} for (t, s), n in counts.items()]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("token", pa.string()), ("state", pa.int32()), ("n", pa.int64())]))

    counted = sample.mapInArrow(work, "token string, state int, n bigint")
    by_state = [F.sum(F.when(F.col("state") == s, F.col("n")).otherwise(0)).alias(f"n{s}") for s in (OUT, IN)]
    found = counted.groupBy("token").agg(*by_state, F.sum("n").alias("n")).where(F.col("n") >= LEAST_PAGES)
    return found.orderBy(F.desc("n"), "token").limit(MOST_TOKENS)


class TokenScores:
    """Learned log-odds of attribute tokens; an unknown one takes that of the longest known token it begins or ends with."""

    def __init__(self, scores):
        self.scores, self.known = scores, dict(scores)

    def __call__(self, token):
        if token not in self.known:
            if len(self.known) > 200_000:
                self.known = dict(self.scores)
            parts = [token[:k] for k in range(len(token) - 1, 3, -1)] + [token[-k:] for k in range(len(token) - 1, 3, -1)]
            parts.sort(key=len, reverse=True)
            self.known[token] = next((self.scores[p] for p in parts if p in self.scores), 0.0)
        return self.known[token]


def fit(pages, save, html="html", max_pages=300, layouts=3, max_nodes=400, rounds=60):
    """The model, or None without any page to learn from: token scores and trees, of bounded size."""
    sample = save(sample_of(pages, max_pages, html))
    counts = _token_counts(sample, layouts).collect()
    scores = {r.token: float(np.clip(np.log((r.n1 + 1) / (r.n0 + 1)), -3, 3)) for r in counts}

    def work(batches):
        score_of = TokenScores(scores)
        for h, forest in _training_forests(batches, layouts):
            arrays = forest.arrays()
            if arrays.n:
                x, y = arrays.features(score_of), arrays.labels()
                rng = np.random.default_rng(abs(h))
                picked = rng.permutation(arrays.n)[: max_nodes * forest.pages]
                # Parts of few nodes count as much as those of many.
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[picked].tobytes()]), pa.array([y[picked].astype(np.uint8).tobytes()]), pa.array([h], pa.int64()), pa.array([forest.pages], pa.int64())], names=["x", "y", "h", "n"]
                )

    # At most max_pages * (1 + layouts) * max_nodes rows of features.
    rows = sample.mapInArrow(work, "x binary, y binary, h bigint, n bigint").orderBy("h", "n").collect()
    if not rows:
        return None
    y = np.concatenate([np.frombuffer(r.y, np.uint8) for r in rows]).astype(np.int64)
    x = np.concatenate([np.frombuffer(r.x, np.float32) for r in rows]).reshape(len(y), -1)
    return {"scores": scores, "trees": boosting.fit(x, y, 3, rounds=rounds)}


def texts_of(htmls, model):
    """The main text of each page."""
    score_of = TokenScores(model["scores"])
    out, forest = [], Forest()

    def done():
        if not forest.pages:
            return
        arrays = forest.arrays()
        state = arrays.decode(boosting.log_shares(arrays.features(score_of), model["trees"]))
        blocks = [[] for _ in range(forest.pages)]
        for i in np.flatnonzero((state == IN) & (arrays.chars > 0)):
            blocks[forest.page[i]].append(forest.text[i])
        out.extend("\n\n".join(b) for b in blocks)

    for html in htmls:
        forest.add(html or "")
        if len(forest.tag) >= NODES:
            done()
            forest = Forest()
    done()
    return out


def extract(pages, model, html="html", keep=("page_id", "url")):
    """The ``keep`` columns with ``text`` and ``n_chars`` (code points) of every page."""
    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)
    shared = pages.sparkSession.sparkContext.broadcast(model)
    n = len(keep)

    def work(batches):
        for batch in batches:
            at = 0
            for part in portions(batch.column(n), most=4_000_000):
                texts = texts_of(part.to_pylist(), shared.value) if shared.value else [""] * len(part)
                own = [batch.column(k).slice(at, len(part)) for k in range(n)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])
                at += len(part)

    return pages.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{html}`").alias("_html")).mapInArrow(work, f"{kinds}, text string, n_chars bigint")
