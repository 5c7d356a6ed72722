"""Byte-level BPE: encoding and decoding with the tokenizers library over Arrow batches.

``encode`` gives ids and offsets, ``decode`` the bytes and text of ids.  The merge
ranks come from a rank file (base64 token, rank), given as a path that the driver can
read; its content is broadcast, so its size is that of one vocabulary.

Defined cases: a null text is an empty one (no ids, empty bytes); repeated rows give
repeated rows; an empty table gives an empty table; other columns, also ones with the
names of results, are not read.  A whole text goes through one call, never a prefix.
"""

import base64
import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
import regex

from inspectlake.llm.arrays import portions

# The pattern that splits text before merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Words (with the blank before them) whose ids a worker remembers at a time, and their greatest length.
REMEMBERED_WORDS = 200_000
REMEMBERED_CHARS = 64

ENCODED = {
    "ids": ("array<int>", pa.list_(pa.int32())),
    "starts": ("array<int>", pa.list_(pa.int32())),
    "ends": ("array<int>", pa.list_(pa.int32())),
    "n_tokens": ("bigint", pa.int64()),
    "ids_sha256": ("string", pa.string()),
    "decoded_sha256": ("string", pa.string()),
}


def byte_chars():
    """The character that stands for each byte: itself where printable, else one from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def read_ranks(content):
    """Token bytes to rank out of the content of a rank file."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in content.splitlines() if line)}


class Codec:
    """One vocabulary: the library's merge model for encoding, the byte table for decoding.

    Text is cut at each blank between two visible characters: no match of the pattern
    reaches over such a blank from the left, so the ids of a word stay the same in any
    text and are remembered.
    """

    def __init__(self, content, pattern):
        from tokenizers import models

        ranks = read_ranks(content)
        shown = byte_chars()
        name = {token: "".join(map(shown.__getitem__, token)) for token in ranks}
        # Every pair of tokens whose join is a token may merge, at the join's rank.
        merges = [
            (name[token[:cut]], name[token[cut:]])
            for token in sorted(ranks, key=ranks.get)
            for cut in range(1, len(token))
            if token[:cut] in ranks and token[cut:] in ranks
        ]
        self.model = models.BPE(vocab={name[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True)
        self.shown = {b: ord(c) for b, c in shown.items()}
        self.pieces = regex.compile(pattern)
        self.words = re.compile(r"(?<=\S) (?=\S)")
        self.known = {}
        self.tokens = np.full(max(ranks.values(), default=-1) + 1, None, dtype=object)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.widths = np.array([len(t or b"") for t in self.tokens], dtype=np.int64)

    def _ids(self, word):
        """Packed ids of one word, piece by piece."""
        ids = []
        for piece in self.pieces.findall(word):
            ids += [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.shown))]
        packed = np.array(ids, dtype="<u4").tobytes()
        if len(word) <= REMEMBERED_CHARS:
            if len(self.known) >= REMEMBERED_WORDS:
                self.known.clear()
            self.known[word] = packed
        return packed

    def encode(self, text):
        """The ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        first, *rest = self.words.split(text)
        packed = [self._ids(first)]
        known = self.known
        for word in rest:
            word = " " + word
            packed.append(known.get(word) or self._ids(word))
        return b"".join(packed)

    def bytes_of(self, ids):
        return b"".join(self.tokens[ids].tolist())

    def spans(self, text, ids):
        """First and past-last code point of each token."""
        if not len(ids):
            return ids, ids
        ends = np.cumsum(self.widths[ids])
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        char = np.cumsum((raw & 0xC0) != 0x80) - 1
        return char[ends - self.widths[ids]], char[ends - 1] + 1


@functools.lru_cache(maxsize=4)
def _codec(content, pattern):
    return Codec(content, pattern)


def _content(spark, ranks_path):
    with open(ranks_path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs, ranks_path, columns=("ids", "starts", "ends", "n_tokens"), pattern=PATTERN, key="doc_id", text="text"):
    """``key`` and the wanted ``columns`` of ``ENCODED`` for each row.

    ``starts`` and ``ends`` are code points of the text; the parts of a character that
    is split over several tokens all carry that character's span.
    """
    shared = _content(docs.sparkSession, ranks_path)
    wanted = list(columns)

    def work(batches):
        codec = _codec(shared.value, pattern)
        for batch in batches:
            at = 0
            for part in portions(batch.column(1)):
                out = {c: [] for c in wanted}
                for text in part.to_pylist():
                    packed = codec.encode(text)
                    ids = np.frombuffer(packed, dtype="<u4")
                    if "starts" in out or "ends" in out:
                        starts, ends = codec.spans(text, ids)
                    for c in wanted:
                        if c == "ids":
                            out[c].append(ids.astype(np.int32))
                        elif c == "starts":
                            out[c].append(starts)
                        elif c == "ends":
                            out[c].append(ends)
                        elif c == "n_tokens":
                            out[c].append(len(ids))
                        elif c == "ids_sha256":
                            out[c].append(hashlib.sha256(packed).hexdigest())
                        else:
                            out[c].append(hashlib.sha256(codec.bytes_of(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(part)), *(pa.array(out[c], ENCODED[c][1]) for c in wanted)], names=["key", *wanted]
                )
                at += len(part)
        # The worker lives on and may serve other steps.
        codec.known.clear()

    kind = docs.schema[key].dataType.simpleString()
    schema = ", ".join([f"key {kind}", *(f"{c} {ENCODED[c][0]}" for c in wanted)])
    return docs.select(key, text).mapInArrow(work, schema).withColumnRenamed("key", key)


def decode(encoded, ranks_path, pattern=PATTERN, key="doc_id", ids="ids"):
    """``key``, ``decoded`` (bytes) and ``text`` of each row's ids.

    Bytes are joined before they are read as text, so a character that several ids
    share comes out whole; bytes that are no UTF-8 become replacement characters.
    Null ids are no ids; an id outside the vocabulary fails the task.
    """
    shared = _content(encoded.sparkSession, ranks_path)

    def work(batches):
        codec = _codec(shared.value, pattern)
        for batch in batches:
            whole = [codec.bytes_of(np.array(x or [], dtype=np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(whole, pa.binary()), pa.array([b.decode("utf-8", "replace") for b in whole], pa.string())],
                names=["key", "decoded", "text"],
            )

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(key, ids).mapInArrow(work, f"key {kind}, decoded binary, text string").withColumnRenamed("key", key)
