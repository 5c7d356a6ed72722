"""Quality classifier: random Fourier features over document statistics.

A Gaussian kernel over standardised document statistics is approximated by random
Fourier features; every partition sums its part of the normal equations, one small
system is solved for the ridge scores, and isotonic regression turns scores into
probabilities.  Labels come from a bounded sample (``max_train`` rows, picked by a hash
of the id, so reruns pick the same); scoring covers every row and whole texts.

Defined cases: a null or empty text has all-zero statistics and is scored like any
other text; repeated rows are scored alike; without usable labels every score is 0.5;
an empty table gives an empty table; other columns are passed on unread.  Labels
other than 0 and 1 and null ids teach nothing; an id with several labels counts by
their mean.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from inspectlake.llm.arrays import SPACE, combined, portions, runs, span_hashes, text_bytes
from inspectlake.llm.sampling import within

#: Statistics of one document, in order.
STATISTICS = [
    "log_words", "word_bytes", "upper", "digit", "symbol", "bar", "bang", "stop_mark", "comma", "wide", "line_words",
    "repeat_lines", "repeat_neighbours", "distinct_words", "repeat_shingles", "top_shingle", "word_spread", "one_letter",
]
_CLASSES = ["other", "lower", "upper", "digit", "symbol", "bar", "bang", "stop", "comma", "wide", "line", "space"]
_CLASS = np.zeros(256, dtype=np.int32)
for _name, _bytes in {
    "lower": range(ord("a"), ord("z") + 1), "upper": range(ord("A"), ord("Z") + 1), "digit": range(ord("0"), ord("9") + 1),
    "symbol": b"#*$%&<>@^~{}[]\\/=+_", "bar": b"|", "bang": b"!?", "stop": b".", "comma": b",;:", "wide": range(128, 256),
    "line": b"\n", "space": b" \t\r\v\f",
}.items():
    _CLASS[list(_bytes)] = _CLASSES.index(_name)

FEATURES = 160
BINS = 512


def statistics(column):
    """One row of ``STATISTICS`` for each text of the column."""
    parts = [_statistics(part) for part in portions(column)]
    return np.concatenate(parts) if parts else np.zeros((0, len(STATISTICS)))


def _statistics(column):
    raw, offsets = text_bytes(column)
    n = len(offsets) - 1
    row = np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets))
    k = len(_CLASSES)
    count = np.bincount(row * k + _CLASS[raw], minlength=n * k).reshape(n, k).astype(float)
    starts, ends = runs(~SPACE[raw], offsets)
    first = np.searchsorted(starts, offsets)
    hashes, length = span_hashes(raw, starts, ends), (ends - starts).astype(float)
    line_starts, line_ends = runs(raw != 10, offsets)
    line_first = np.searchsorted(line_starts, offsets)
    lines = span_hashes(raw, line_starts, line_ends)
    windows = combined(hashes, 5)
    out = np.zeros((n, len(STATISTICS)))
    by = dict(zip(_CLASSES, count.T))
    ink = np.maximum(1, count.sum(axis=1) - by["space"] - by["line"])
    total = np.diff(first).astype(float)
    some = np.maximum(1, total)
    letters = np.maximum(1, by["lower"] + by["upper"])
    out[:, 0] = np.log1p(total)
    out[:, 1] = np.log1p(ink / some)
    for at, name, per in ((2, "upper", letters), (3, "digit", ink), (4, "symbol", some), (5, "bar", some), (6, "bang", some), (7, "stop", some), (8, "comma", some), (9, "wide", ink)):
        out[:, at] = np.sqrt(by[name] / per)
    out[:, 10] = np.log1p(total / (1 + by["line"]))
    for i in range(n):
        a, b = first[i], first[i + 1]
        if a == b:
            continue
        h, w = hashes[a:b], length[a:b]
        own = lines[line_first[i] : line_first[i + 1]]
        out[i, 11] = 1 - len(np.unique(own)) / len(own)
        out[i, 12] = np.mean(h[1:] == h[:-1]) if b - a > 1 else 0
        out[i, 13] = len(np.unique(h)) / (b - a)
        if b - a > 5:
            own = np.sort(windows[a : b - 4])
            edges = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1], [True])))
            out[i, 14] = 1 - (len(edges) - 1) / len(own)
            out[i, 15] = np.sqrt(np.diff(edges).max() / len(own)) if out[i, 14] else 0
        out[i, 16] = np.log1p(w.std())
        out[i, 17] = np.mean(w == 1)
    return out


def projection(seed, dims, features=FEATURES, width=4.0):
    """Directions and phases of the random features for a Gaussian kernel of that width."""
    rng = np.random.default_rng(seed)
    return rng.normal(0, 1 / width, (dims, features)), rng.uniform(0, 2 * math.pi, features)


def fourier(x, model):
    """Random features, the statistics themselves and a constant."""
    x = np.clip((x - model["mean"]) / model["spread"], -8, 8)
    directions, phases = projection(model["seed"], x.shape[1])
    waves = math.sqrt(2 / len(phases)) * np.cos(x @ directions + phases)
    return np.hstack([waves, x / 10, np.ones((len(x), 1))])


def pooled(bins, counts, positives):
    """Isotonic (never falling) rates over bins in order: pool neighbours that fall."""
    blocks = []
    for at, n, p in zip(bins, counts, positives):
        blocks.append([at, at, n, p])
        while len(blocks) > 1 and blocks[-2][3] * blocks[-1][2] >= blocks[-1][3] * blocks[-2][2]:
            _, last, n2, p2 = blocks.pop()
            blocks[-1][1] = last
            blocks[-1][2] += n2
            blocks[-1][3] += p2
    knots = [(at, (p + 0.5) / (n + 1)) for low, high, n, p in blocks for at in ({low, high} if low != high else {low})]
    knots.sort()
    at, rate = map(np.array, zip(*knots))
    return at.astype(float), np.maximum.accumulate(rate)


def labelled_rows(labels, key="doc_id", label="quality", max_train=60_000):
    """``key`` and mean ``label`` of at most about ``max_train`` ids outside the held-out third."""
    ids = F.col(key).cast("string")
    usable = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & (F.crc32(ids) % 3 != 1))
    usable = usable.groupBy(key).agg(F.avg(label).alias("_y"))
    return usable.where(within(F.xxhash64(ids, F.lit(7)), max_train, usable.count()))


def fit(docs, labels, key="doc_id", text="text", label="quality", max_train=60_000, ridge=1e-3, seed=17, save=None):
    """The model: a small dict of arrays (fixed size), or None without usable labels.

    ``save`` writes the statistics of the sample once and reads them back.
    """
    sample = labelled_rows(labels, key, label, max_train)
    if sample.isEmpty():
        return None
    count = F.arrow_udf("array<double>")(_statistics_list)
    # The sample has at most about max_train ids: small enough for every executor.
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("_id"), F.col(text).alias("_t"))
    rows = rows.join(F.broadcast(sample.select(F.col(key).alias("_id"), "_y")), "_id").select("_id", "_y", count("_t").alias("_x"))
    rows = save(rows) if save else rows
    rows = rows.withColumn("_fold", F.pmod(F.xxhash64(F.col("_id").cast("string"), F.lit(11)), F.lit(4)))
    dims = len(STATISTICS)
    moments = [F.avg(F.col("_x")[i]) for i in range(dims)] + [F.stddev_pop(F.col("_x")[i]) for i in range(dims)]
    found = rows.agg(F.count("*"), *moments).first()
    if not found[0]:
        return None
    mean, spread = np.array(found[1 : 1 + dims]), np.array(found[1 + dims :])
    model = {"seed": seed, "mean": mean, "spread": np.where(spread > 1e-9, spread, 1.0)}

    def equations(x, y):
        z = fourier(x, model)
        return np.concatenate([(z.T @ z).ravel(), z.T @ (y - 0.5)])

    train = rows.where("_fold > 0")
    sums = _partition_sums(train, equations)
    if sums is None:
        train, sums = rows, _partition_sums(rows, equations)
    size = FEATURES + dims + 1
    gram, right = sums[: size * size].reshape(size, size), sums[size * size :]
    model["beta"] = np.linalg.solve(gram + ridge * gram[-1, -1] * np.eye(size), right)

    def histogram(x, y):
        at = np.clip((raw_scores(x, model) + 0.5) * BINS, 0, BINS - 1).astype(int)
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at, weights=y, minlength=BINS)])

    bins = _partition_sums(rows.where("_fold = 0"), histogram)
    bins = bins if bins is not None else _partition_sums(rows, histogram)
    used = np.flatnonzero(bins[:BINS])
    model["knots"] = pooled(used, bins[:BINS][used], bins[BINS:][used])
    return model


def _statistics_list(column: pa.Array) -> pa.Array:
    return pa.array(list(statistics(column)), pa.list_(pa.float64()))


def _partition_sums(rows, part_of):
    """Element-wise sum of ``part_of(x, y)`` over all rows: one array per partition, added up in tasks.

    The array has a fixed size; the number of partitions is that of the bounded sample.
    """

    def work(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column(0).to_pylist(), dtype=float)
                part = part_of(x, batch.column(1).to_numpy(zero_copy_only=False))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    def add(batches):
        total = None
        for batch in batches:
            for part in batch.column(0).to_pylist():
                part = np.frombuffer(part)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    parts = rows.select("_x", "_y").mapInArrow(work, "part binary").coalesce(8).mapInArrow(add, "part binary")
    sums = [np.frombuffer(r.part) for r in parts.collect()]
    return np.sum(sums, axis=0) if sums else None


def raw_scores(x, model):
    return fourier(x, model) @ model["beta"]


def score_udf(model):
    """A column function from text to the calibrated score."""
    if model is None:
        return lambda text: F.lit(0.5)

    def score(column: pa.Array) -> pa.Array:
        x = statistics(column)
        if not len(x):
            return pa.array([], pa.float64())
        at = np.clip((raw_scores(x, model) + 0.5) * BINS, 0, BINS - 1)
        return pa.array(np.interp(at, *model["knots"]))

    return F.arrow_udf("double")(score)


def with_quality(docs, model, text="text", to="score"):
    """The rows with the score of their whole text, 0 to 1, in the column ``to``."""
    return docs.withColumn(to, score_udf(model)(F.col(text)))
