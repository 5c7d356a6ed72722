"""Secret scans: fixed patterns, and guess costs of values in a credential context.

The base kinds are ``assign``, ``access`` and ``hex`` (patterns below).  The kind
``guess`` adds values that stand after a credential word and that a minimum-cost
segmentation into words, dates, repeats, keyboard walks and brute-force spans finds
costly to guess; a value ends before the next form field
(``&name=``) and the next credential word with its sign.
Base spans stay as they are, and the part of a value outside them is costed alone.

Defined cases: a null or empty text has no spans; spans count code points, the end
exclusive; repeated rows get equal spans; an empty table gives an empty table; other
columns are passed on unread.  Work grows linearly with the length of a text.
"""

import bisect
import functools
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

# The base patterns, with the least length of what they must hold.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_CHARS = 12
ACCESS = r"AKIA[A-Z0-9]+"
ACCESS_CHARS = 18
HEX = r"[0-9a-f]+"
HEX_CHARS = 16

KINDS = ("assign", "access", "hex", "guess")

#: Words that stand before a credential, lower case.
CONTEXT = ("password", "passwd", "passphrase", "pwd", "secret", "token", "api_key", "apikey", "api-key", "access_key", "private_key", "credential", "auth_key")
#: Words that people use in passwords, the most common first.
WORDS = (
    "password", "admin", "welcome", "login", "master", "secret", "letmein", "dragon", "monkey", "shadow", "sunshine", "princess",
    "football", "baseball", "superman", "batman", "trustno", "hello", "freedom", "whatever", "access", "default", "guest", "user",
    "root", "test", "demo", "example", "sample", "change", "changeme", "temp", "summer", "winter", "spring", "autumn", "love",
    "pass", "token", "key", "api", "server", "system", "public", "private", "none", "null", "true", "false", "your", "here",
)
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz")

LEET = str.maketrans("@4301!5$7", "aaeoliss" + "t")
#: log10 of the guesses that make a value a secret, and the shortest value looked at.
LEAST_COST = 11.0
LEAST_CHARS = 8

_ASSIGN = re.compile(f"(?ai:{ASSIGN})")
_ACCESS = re.compile(f"AKIA[A-Z0-9]{{{ACCESS_CHARS - 4},}}")
_HEX = re.compile(f"[0-9a-f]{{{HEX_CHARS},}}")
_BEFORE = r"""(?:%s)["']?\s{0,4}(?:=>|:=|[:=])\s{0,4}["']?""" % "|".join(re.escape(w) for w in CONTEXT)
# A value ends before the next field of a form (``&name=``) and the next credential word with its sign.
_VALUE = re.compile(rf"""(?ai:{_BEFORE})((?:(?!(?ai:{_BEFORE})|&[\w.%\[\]-]{{1,64}}=)[^\s"'`,;|<>])+)""")
_DATE = re.compile(r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)?\d\d|(?:19|20)\d\d")
_REPEAT = re.compile(r"(.{1,8}?)\1{2,}", re.S)


@functools.lru_cache(maxsize=8)
def _ranked(words):
    return {w: math.log10(k + 2) for k, w in enumerate(words)}, max(map(len, words), default=0)


def _walk(low, at):
    """End of the longest walk along one keyboard row, in one direction, that begins at ``at`` of a lower-case value."""
    longest = at + 1
    for row in ROWS:
        place = row.find(low[at])
        if place < 0:
            continue
        for move in (1, -1):
            end, here = at + 1, place + move
            while end < len(low) and 0 <= here < len(row) and row[here] == low[end]:
                end, here = end + 1, here + move
            longest = max(longest, end)
    return longest


def _brute(char):
    """log10 of the tries for one character outside any pattern."""
    return 1.0 if char.islower() or char.isdigit() else 1.4 if char.isupper() else 1.5


def guess_cost(value, words=WORDS):
    """log10 of the guesses of the cheapest segmentation of the value."""
    ranks, longest = _ranked(tuple(words))
    # Lower case once; a letter that changes the length keeps the value as it is.
    low = value.lower()
    low = low if len(low) == len(value) else value
    plain = low.translate(LEET)
    best = [0.0] + [math.inf] * len(value)

    def offer(start, end, cost):
        # A segment more doubles the orders to try.
        best[end] = min(best[end], best[start] + cost + (0.3 if start else 0.0))

    brute_at = math.inf  # the best cost of a brute-force span that is still open
    repeats = {m.start(): m for m in _REPEAT.finditer(value)}
    for at in range(len(value)):
        brute_at = min(brute_at, best[at] + (0.3 if at else 0.0)) + _brute(value[at])
        for size in range(3, min(longest, len(value) - at) + 1):
            rank = ranks.get(plain[at : at + size])
            if rank is not None:
                piece = value[at : at + size]
                offer(at, at + size, rank + (0.0 if piece.islower() else 0.6))
        found = _DATE.match(value, at)
        if found:
            offer(at, found.end(), 2.1 if found.end() - at == 4 else 4.6)
        if at in repeats:
            unit, end = repeats[at][1], repeats[at].end()
            offer(at, end, sum(map(_brute, unit)) + math.log10((end - at) // len(unit)))
        end = _walk(low, at)
        if end - at >= 3:
            offer(at, end, 1.7 + math.log10(end - at))
        best[at + 1] = min(best[at + 1], brute_at)
    return best[-1]


def _outside(start, end, base):
    """The parts of [start, end) outside the base spans, which are in order."""
    at = bisect.bisect_right(base, start, key=lambda s: s[1])
    while at < len(base) and base[at][0] < end:
        if start < base[at][0]:
            yield start, base[at][0]
        start, at = base[at][1], at + 1
    if start < end:
        yield start, end


def spans(text, words=WORDS, least_cost=LEAST_COST):
    """(kind, start, end, cost) of every span, by start and kind; cost only for ``guess``."""
    found = []
    if not text:
        return found
    low = text.lower()
    if any(w in low for w in CONTEXT):
        base = [m.span() for m in _ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
        found += [("assign", a, b, None) for a, b in base]
        for m in _VALUE.finditer(text):
            for a, b in _outside(*m.span(1), base):
                value = text[a:b].rstrip(".:)!?")
                if len(value) >= LEAST_CHARS:
                    cost = guess_cost(value, words)
                    if cost >= least_cost:
                        found.append(("guess", a, a + len(value), cost))
    if "AKIA" in text:
        found += [("access", *m.span(), None) for m in _ACCESS.finditer(text)]
    found += [("hex", *m.span(), None) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def secrets_udf(words=WORDS, least_cost=LEAST_COST):
    """A column function from text to its spans."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("cost", pa.float64())]))

    def scan(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            rows = [[dict(zip(("kind", "start", "end", "cost"), s)) for s in spans(t.as_py(), words, least_cost)] for t in column]
            yield pa.array(rows, kind)

    return F.arrow_udf("array<struct<kind: string, start: int, end: int, cost: double>>")(scan)


def with_secrets(docs, text="text", to="secrets", words=WORDS, least_cost=LEAST_COST):
    """The rows with the array of their whole text's spans in the column ``to``."""
    return docs.withColumn(to, secrets_udf(words, least_cost)(F.col(text)))
