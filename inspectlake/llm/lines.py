"""Line dedup: a segment-partition edit join over the lines of all documents.

A line goes if it equals an earlier line (by doc_id and place) or lies within
``THRESHOLD`` edits of one.  Lines of ``SHORTEST`` code points or more are cut into
threshold + 1 segments: of two lines within the threshold, one has a segment that the
other holds unchanged near the same place.  Segments are index keys (with their number
and the line's length); a line probes with the substrings that can match segments of
lines up to ``THRESHOLD`` shorter.  Lines that share a key are verified with a banded
bit-parallel edit distance.

Keys travel as 64-bit hashes, once per task and line; keys of one line alone are dropped
while they stream by.  A key with very many lines is dealt over pairs of blocks, each
pair of lines in exactly one; a task returns one row per line it finds to be a repeat.

Defined cases: a null text stays null; lines without a visible character always stay;
lines are told apart by everything but the line feed; rows that share id and text are
one document and get equal results; rows with a null id stay as they are and take no
part; an empty table gives an empty table; other columns are passed on, except that
``n_lines`` and ``n_dropped`` are replaced.  A document whose lines all go stays, empty.
"""

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from inspectlake.llm.arrays import SPACE, mixed, portions, prefix_hashes, runs, span_hashes, text_bytes

THRESHOLD = 2
#: Shorter lines go only if they are equal.
SHORTEST = 20
BLOCK = 256
#: Line hashes a task remembers, so that it sends the keys of a line once.
REMEMBERED = 1_000_000

_LINE = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("line_no", pa.int32()), ("h", pa.int64())])
_KEY = pa.schema([("key", pa.int64()), ("h", pa.int64()), ("is_index", pa.bool_())])


def _line_spans(column):
    """Code points of the texts end to end; document, place, begin and end of every line with a visible character."""
    raw, offsets = text_bytes(column)
    codes = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    lead = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    offsets = lead[offsets]
    starts, ends = runs(codes != 10, offsets)
    shown = np.concatenate(([0], np.cumsum((codes > 0xFF) | ~SPACE[np.minimum(codes, 0xFF)])))
    some = shown[ends] > shown[starts]
    starts, ends = starts[some], ends[some]
    feeds = np.concatenate(([0], np.cumsum(codes == 10)))
    doc = np.searchsorted(offsets, starts, side="right") - 1
    return codes, doc, feeds[starts] - feeds[offsets[doc]], starts, ends


def line_table(docs, key="doc_id", text="text"):
    """(doc_id, th, line_no, h): every line with a visible character; th and h are hashes of text and line."""

    def work(batches):
        for batch in batches:
            at = 0
            for part in portions(batch.column(2)):
                ids, hashes = batch.column(0).slice(at, len(part)), batch.column(1).slice(at, len(part))
                at += len(part)
                codes, doc, place, starts, ends = _line_spans(part)
                doc = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(doc), hashes.take(doc), pa.array(place.astype(np.int32)), pa.array(span_hashes(codes, starts, ends).view(np.int64))],
                    schema=_LINE,
                )

    rows = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull())
    rows = rows.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    return rows.mapInArrow(work, "doc_id bigint, th bigint, line_no int, h bigint")


def selections(threshold=THRESHOLD):
    """(shorter, segment, shift, is_index) of every substring a line sends.

    ``shorter`` is how much shorter the lines are whose segments it can match; its
    begin is ``shift`` after the segment's begin in such a line.  A substring at its own
    segment is an index key too.
    """
    for shorter in range(threshold + 1):
        for segment in range(threshold + 1):
            left, right = segment, threshold - segment
            for shift in range(max(-left, shorter - right), min(left, shorter + right) + 1):
                yield shorter, segment, shift, shorter == 0 and shift == 0


def segment_keys(codes, starts, ends, threshold=THRESHOLD):
    """Key and is_index of every substring of every line: arrays of (selections, lines)."""
    chosen = list(selections(threshold))
    keys = np.zeros((len(chosen), len(starts)), dtype=np.uint64)
    parts = threshold + 1
    for a, b, hash_of in prefix_hashes(codes, starts, ends):
        s, length = starts[a:b], ends[a:b] - starts[a:b]
        for k, (shorter, segment, shift, _) in enumerate(chosen):
            other = length - shorter
            size, longer = other // parts, other % parts
            # The last segments are one longer where the length does not divide.
            extra = np.maximum(0, segment - (parts - longer))
            begin = s + segment * size + extra + shift
            end = begin + size + (segment >= parts - longer)
            tag = mixed((other * parts + segment).astype(np.uint64) + np.uint64(1 << 40))
            keys[k, a:b] = mixed(hash_of(begin, end) ^ tag)
    return keys, np.array([c[3] for c in chosen])


def _key_rows(threshold):
    def work(batches):
        seen = set()
        for batch in batches:
            for part in portions(batch.column(0)):
                codes, _, _, starts, ends = _line_spans(part)
                long = ends - starts >= SHORTEST
                starts, ends = starts[long], ends[long]
                h = span_hashes(codes, starts, ends).view(np.int64)
                _, first = np.unique(h, return_index=True)
                first = first[[x not in seen for x in h[first].tolist()]]
                if len(seen) > REMEMBERED:
                    seen.clear()
                seen.update(h[first].tolist())
                first = np.sort(first)
                keys, is_index = segment_keys(codes, starts[first], ends[first], threshold)
                n = len(first)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel().view(np.int64)), pa.array(np.tile(h[first], len(keys))), pa.array(np.repeat(is_index, n))], schema=_KEY
                )

    return work


def _shared_keys(batches):
    """Of rows sorted by key, line and is_index (true first): those whose key another line has too.

    Each line comes once per key, as an index if it is one.
    """
    last = sent = None  # the row before, and whether it has been sent
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if last is not None:
            columns = [np.concatenate(([x], c)) for x, c in zip(last, columns)]
        key, h, _ = columns
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (h[1:] != h[:-1])
        columns = [c[new] for c in columns]
        key = columns[0]
        shared = np.zeros(len(key), dtype=bool)
        shared[1:] |= key[1:] == key[:-1]
        shared[:-1] |= key[1:] == key[:-1]
        at_end = bool(shared[-1])
        if last is not None:
            at_end |= len(key) == 1 and sent
            shared[0] &= not sent
        last, sent = [c[-1] for c in columns], at_end
        if shared.any():
            yield pa.RecordBatch.from_arrays([pa.array(c[shared]) for c in columns], schema=_KEY)


def within(a, b, limit=THRESHOLD):
    """Whether two strings are at most ``limit`` edits apart: banded, bit-parallel.

    Bit k of reached[d] says that the prefix of ``a`` read so far and the prefix of
    ``b`` longer by k - limit are at most d edits apart.
    """
    if abs(len(a) - len(b)) > limit:
        return False
    start = _common(a, b)
    a, b = a[start:], b[start:]
    stop = _common(a[::-1], b[::-1])
    a, b = a[: len(a) - stop], b[: len(b) - stop]
    band = (1 << (2 * limit + 1)) - 1
    reached = [((1 << (d + 1)) - 1) << limit & band for d in range(limit + 1)]
    for i, c in enumerate(a):
        equal = 0
        for k in range(max(0, limit - i), min(2 * limit, len(b) - 1 - i + limit) + 1):
            if b[i + k - limit] == c:
                equal |= 1 << k
        now = [reached[0] & equal]
        for d in range(1, limit + 1):
            # Match, replace, drop from a, drop from b.
            now.append((reached[d] & equal | reached[d - 1] | reached[d - 1] >> 1 | now[d - 1] << 1) & band)
        reached = now
        if not reached[limit]:
            return False
    return bool(reached[limit] >> (len(b) - len(a) + limit) & 1)


def _common(a, b):
    """Length of the common beginning."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def _repeats(threshold):
    """Lines within the threshold of an earlier one, out of groups of lines that share a key."""

    def work(batches):
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
        found = []
        for _, group in itertools.groupby(rows, key=lambda r: r[:3]):
            group = sorted(group, key=lambda r: r[7:])
            across = group[0][1] != group[0][2]
            for k in range(1, len(group)):
                _, _, _, own, index, h, line, *_ = group[k]
                for _, _, _, own2, index2, h2, line2, *_ in group[:k]:
                    if h != h2 and (index or index2) and (own != own2) == across and within(line, line2, threshold):
                        found.append(h)
                        break
            if len(found) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["h"])
                found = []
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["h"])

    return work


def _texts_of(docs, wanted, key, text):
    """(h, line, doc_id, th, line_no) of the wanted lines: their text out of the documents."""
    by_doc = wanted.groupBy("doc_id", "th").agg(F.collect_list(F.struct("line_no", "h")).alias("picked"))
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), F.col(text).alias("text")).where("doc_id is not null")
    rows = texts.join(by_doc, ["doc_id", "th"])
    line = lambda parts, p: F.struct(p["h"].alias("h"), p["line_no"].alias("line_no"), F.get(parts, p["line_no"]).alias("line"))
    # The pieces are bound once, so a place costs one look-up.
    taken = F.transform(F.array(F.split("text", "\n")), lambda parts: F.transform("picked", lambda p: line(parts, p)))[0]
    rows = rows.select("doc_id", "th", F.explode(taken).alias("x"))
    return rows.select("x.h", "x.line", "doc_id", "th", "x.line_no").dropDuplicates(["h"])


def near_repeats(docs, firsts, save, key="doc_id", text="text", threshold=THRESHOLD):
    """(h): hashes of the lines that lie within the threshold of an earlier line."""
    keys = docs.where(F.col(key).isNotNull()).select(text).mapInArrow(_key_rows(threshold), "key bigint, h bigint, is_index boolean")
    keys = keys.repartition("key").sortWithinPartitions("key", "h", F.desc("is_index"))
    shared = save(keys.mapInArrow(_shared_keys, "key bigint, h bigint, is_index boolean"))
    sizes = shared.groupBy("key").agg(F.count("*").alias("size"), F.bool_or("is_index").alias("has"))
    sizes = sizes.where("has and size > 1").select("key", F.ceil(F.col("size") / BLOCK).alias("blocks"))
    shared = save(shared.join(sizes, "key"))
    wanted = shared.select("h").distinct().join(firsts, "h")
    texts = save(_texts_of(docs, wanted, key, text))
    own = F.pmod(F.xxhash64(F.lit(9), "h"), F.col("blocks"))
    dealt = shared.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), "own", "is_index", "h").join(texts, "h")
    dealt = dealt.select("key", "bi", "bj", "own", "is_index", "h", "line", "doc_id", "th", "line_no")
    dealt = dealt.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
    return dealt.mapInArrow(_repeats(threshold), "h bigint").distinct()


def dedup_lines(docs, save, key="doc_id", text="text", threshold=THRESHOLD, counts=("n_lines", "n_dropped")):
    """The rows with ``text`` without its repeated lines, and the numbers of lines and of dropped lines.

    Lines without a visible character do not count.  ``save`` writes a frame to shared
    storage and reads it back.
    """
    docs = docs.drop(*counts)
    lines = save(line_table(docs, key, text))
    firsts = lines.groupBy("h").agg(F.min(F.struct("doc_id", "th", "line_no")).alias("first"))
    firsts = save(firsts.select("h", "first.*"))
    near = save(near_repeats(docs, firsts, save, key, text, threshold).withColumn("near", F.lit(True)))
    kept = firsts.join(near, "h", "left").select("h", F.struct("doc_id", "th", "line_no").alias("first"), F.coalesce("near", F.lit(False)).alias("near"))
    gone = F.col("near") | (F.struct("doc_id", "th", "line_no") != F.col("first"))
    judged = lines.join(kept, "h").select("doc_id", "th", "line_no", gone.alias("gone"))
    by_doc = judged.groupBy("doc_id", "th").agg(
        F.collect_set(F.when(F.col("gone"), F.col("line_no"))).alias("_gone"), F.count_distinct("line_no").alias("_lines")
    )
    by_doc = by_doc.withColumnsRenamed({"doc_id": "_id", "th": "_th"})
    rows = docs.withColumns({"_id0": F.col(key).cast("long"), "_th0": F.xxhash64(text)})
    rows = rows.join(by_doc, (F.col("_id0") == F.col("_id")) & (F.col("_th0") == F.col("_th")), "left")
    parts = F.split(text, "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("_gone"))
    # The pieces are bound once, so a place costs one look-up.
    new = F.transform(F.array(parts), lambda p: F.array_join(F.transform(stay, lambda i: F.get(p, i)), "\n"))[0]
    rows = rows.withColumn(text, F.when(F.size("_gone") > 0, new).otherwise(F.col(text)))
    rows = rows.withColumns(dict(zip(counts, (F.coalesce("_lines", F.lit(0)), F.coalesce(F.size("_gone"), F.lit(0)).cast("long")))))
    return rows.drop("_id0", "_th0", "_id", "_th", "_gone", "_lines")
