"""Words, shingles and hashes of a batch of texts as NumPy arrays."""

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
#: Bytes hashed at a time; a longer word is hashed whole.
CHUNK = 1 << 19


def mixed(x):
    """A one-to-one scrambling of unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=2)
def _powers(n):
    def table(base):
        row = np.full(n, base, dtype=np.uint64)
        row[0] = 1
        return np.multiply.accumulate(row)

    return table(_BASE), table(_BASE_INVERSE)


def text_bytes(column):
    """UTF-8 bytes of a string column end to end, and where each row begins (one more at the end); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(inside, offsets):
    """Begins and ends of the runs of True, cut at row borders too."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    borders = offsets[1:-1]
    borders = borders[(borders > 0) & (borders < n)]
    begin[borders] = inside[borders]
    end[borders - 1] = inside[borders - 1]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def prefix_hashes(values, starts, ends):
    """(a, b, hash_of) for stretches of about ``CHUNK`` values that hold the spans a to b - 1.

    ``hash_of(s, e)`` gives a 64-bit hash of values[s:e] for arrays of places within
    the stretch.  Spans come in order and do not overlap.
    """
    at = 0
    while at < len(starts):
        first = starts[at]
        stop = max(at + 1, int(np.searchsorted(ends, first + CHUNK, side="right")))
        n = int(ends[stop - 1] - first)
        power, inverse = _powers(max(CHUNK, 1 << (n - 1).bit_length()))
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((values[first : first + n].astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])

        def hash_of(s, e, total=total, inverse=inverse, first=first):
            s, e = s - first, e - first
            return mixed((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

        yield at, stop, hash_of
        at = stop


def span_hashes(values, starts, ends):
    """A 64-bit hash of values[start:end] for each span, spans in order and apart."""
    out = np.empty(len(starts), dtype=np.uint64)
    for a, b, hash_of in prefix_hashes(values, starts, ends):
        out[a:b] = hash_of(starts[a:b], ends[a:b])
    return out


def words(column):
    """Hash of every word of the batch, and the first word of each row (one more at the end)."""
    raw, offsets = text_bytes(column)
    starts, ends = runs(~SPACE[raw], offsets)
    return span_hashes(raw, starts, ends), np.searchsorted(starts, offsets)


def combined(hashes, width):
    """A hash of every ``width`` hashes that follow each other."""
    n = max(0, len(hashes) - width + 1)
    total = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        total = (total + hashes[k : k + n]) * np.uint64(0xA24BAED4963EE407 + 2 * k)
    return mixed(total)


def shingle_sets(column, width):
    """The sorted distinct shingles of each row.

    A row with fewer than ``width`` words has one shingle of all its words; a row
    without words has none.
    """
    hashes, first = words(column)
    whole = combined(hashes, width)
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= width:
            yield np.unique(whole[a : b - width + 1])
        elif b > a:
            yield combined(hashes[a:b], b - a)
        else:
            yield hashes[:0]


def portions(column, most=500_000):
    """The column in slices of about ``most`` bytes, at least one row each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    at, total = 0, 0
    for k, size in enumerate(sizes):
        if total and total + size > most:
            yield column.slice(at, k - at)
            at, total = k, 0
        total += size
    if at < len(column):
        yield column.slice(at)
