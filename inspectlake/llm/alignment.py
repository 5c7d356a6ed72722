"""Cross-tokenizer alignment: which tokens of two vocabularies end at the same byte.

Tokenizer A (byte-level BPE out of a tokenizers file, run by the tiktoken library) reads a blank and the text; tokenizer B
(a sentencepiece model) reads the text and adds that blank itself.  Byte offsets where
tokens of both end cut them into groups, and tokens that end there are linked.

The texts are shuffled whole, so each distinct text is tokenised and aligned once; the
counts of its linked pairs are weighted by its number of copies, and its measures are
joined back to every row.  Counts of the most frequent pairs (``common_pairs`` of them, a
fixed number) are looked up in a broadcast table, those of all others come by a join.

Defined cases: a null or empty text, and one whose tokens of A or B do not spell it, has
no tokens (zeros, no groups, no links); repeated rows give repeated rows, each of which
counts; null ids are kept; an empty table gives an empty table; other columns are not
read.  A whole text is aligned, never a prefix.
"""

import array
import functools
import hashlib
import itertools
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from inspectlake.llm.arrays import portions
from inspectlake.llm.bpe import PATTERN, byte_chars

#: Words, and characters of words, whose alignments a worker remembers at a time.
REMEMBERED_WORDS = 80_000
REMEMBERED_CHARS = 4_000_000
#: New words tokenizer B gets in one text; its time per character grows with very long ones.
WORDS_AT_A_TIME = 60
#: Frequent pairs whose counts every task holds (17 bytes each).
COMMON_PAIRS = 300_000
#: A pair of ids is one integer: id of A times this, plus id of B.
_B_IDS = 1 << 20
#: Bits of such an integer; the bits above hold the number of the text in a batch.
_PAIR_BITS = 44

MEASURES = ["n_a", "n_b", "n_groups", "n_links"]


def ends_together(a_ends, b_ends):
    """(first a, past-last a, first b, past-last b) of each group; ends never fall."""
    groups, at_a, at_b = [], 0, 0
    for end in sorted(set(a_ends) & set(b_ends)):
        to_a, to_b = at_a, at_b
        while to_a < len(a_ends) and a_ends[to_a] <= end:
            to_a += 1
        while to_b < len(b_ends) and b_ends[to_b] <= end:
            to_b += 1
        groups.append((at_a, to_a, at_b, to_b))
        at_a, at_b = to_a, to_b
    return groups


def _among(values, ends):
    """Which values are among the rising ``ends``."""
    return ends[np.minimum(np.searchsorted(ends, values), len(ends) - 1)] == values if len(ends) else np.zeros(len(values), bool)


class Aligner:
    """Two tokenizers and the alignments of words they met.

    A text is cut at each blank between two visible characters: no token of either
    vocabulary reaches over such a blank from the left, so a word is aligned alike in
    every text, and new words are aligned together, as one text.  ``piecewise`` is False
    for a vocabulary B with pieces that do reach over blanks; then a text is one word.
    """

    def __init__(self, a_content, b_content):
        import sentencepiece
        import tiktoken

        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_content)
        byte_of = {shown: b for b, shown in byte_chars().items()}
        content = json.loads(a_content)
        vocabulary, merges = content["model"]["vocab"], content["model"]["merges"]
        self.a_bytes = np.full(max(vocabulary.values()) + 1, b"", dtype=object)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(map(byte_of.__getitem__, token))
        made = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in merges]
        if made != list(range(256, 256 + len(made))) or content["normalizer"] or content["pre_tokenizer"].get("type") != "ByteLevel":
            raise ValueError("tokenizer A has to be a plain byte-level BPE whose ids follow its merges")
        # Special tokens are no merge results, so their strings in a text are plain text.
        ranks = {token: i for i, token in enumerate(self.a_bytes[: 256 + len(made)])}
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.names = [list(map(str, range(len(table)))) for table in (self.a_bytes, range(self.b.get_piece_size()))]
        self.b_bytes = np.full(self.b.get_piece_size(), b"", dtype=object)
        self.b_bytes[:] = [self._piece(i) for i in range(len(self.b_bytes))]
        self.widths = [np.array([len(t) for t in table], dtype=np.int64) for table in (self.a_bytes, self.b_bytes)]
        self.piecewise = not any(b" " in token.lstrip(b" ") for token in self.b_bytes)
        self.words = re.compile(r"(?<=\S) (?=\S)")
        self.edges = re.compile(r"\S(?:.*\S)?", re.S)
        self.clear()

    def clear(self):
        """Forget all words."""
        self.index, self.shown, self.held = {}, [], 0
        # Per word: whether it is spelled, its measures, and where its pairs end.
        self.columns = [array.array("q") for _ in range(6)]
        self.pairs = array.array("q")

    def _piece(self, i):
        if self.b.is_byte(i):
            return bytes([int(self.b.id_to_piece(i)[3:-1], 16)])
        return self.b.id_to_piece(i).replace("▁", " ").encode()

    def _ids(self, texts):
        """Ids of A and of B for texts end to end, a blank before each."""
        a = self.a.encode_ordinary("".join(" " + t for t in texts))
        return np.array(a, np.int64), np.array(list(itertools.chain.from_iterable(self.b.encode(texts, num_threads=1))), np.int64)

    def _shown(self, a, b, groups):
        a, b = (list(map(n.__getitem__, ids.tolist())) for n, ids in zip(self.names, (a, b)))
        return [f"{a[a0] if a1 - a0 == 1 else ','.join(a[a0:a1])}|{b[b0] if b1 - b0 == 1 else ','.join(b[b0:b1])}" for a0, a1, b0, b1 in groups]

    def _keep(self, word, spelled, measures, pairs, shown):
        self.index[word] = len(self.shown)
        self.held += len(word)
        self.shown.append(shown)
        self.pairs.extend(pairs)
        for column, value in zip(self.columns, (spelled, *measures, len(self.pairs))):
            column.append(value)

    def _align_one(self, word):
        """Keep the alignment of a blank and ``word``."""
        raw = b" " + word.encode()
        a, b = self._ids([word])
        if b"".join(self.a_bytes[a]) != raw or b"".join(self.b_bytes[b]) != raw:
            self._keep(word, 0, (0, 0, 0, 0), (), "")
            return
        a_ends, b_ends = (np.cumsum(w[ids]).tolist() for w, ids in zip(self.widths, (a, b)))
        groups, pairs = ends_together(a_ends, b_ends), []
        for a0, a1, b0, b1 in groups:
            last_a = [a[k] for k in range(a0, a1) if a_ends[k] == a_ends[a1 - 1]]
            last_b = [b[k] for k in range(b0, b1) if b_ends[k] == b_ends[b1 - 1]]
            pairs += [int(x * _B_IDS + y) for x in last_a for y in last_b]
        self._keep(word, 1, (len(a), len(b), len(groups), len(pairs)), pairs, ";".join(self._shown(a, b, groups)))

    def _align_all(self, words):
        """Keep the alignments of words that begin and end with visible characters, aligned as one text."""
        text = " ".join(words)
        raw = b" " + text.encode()
        a, b = self._ids([" ".join(words[k : k + WORDS_AT_A_TIME]) for k in range(0, len(words), WORDS_AT_A_TIME)])
        # Past the last byte of each word, with the blank before it.
        stops = np.cumsum([len(w.encode()) + 1 for w in words])
        a_ends, b_ends = (np.cumsum(w[ids]) for w, ids in zip(self.widths, (a, b)))
        common = a_ends[_among(a_ends, b_ends)]
        plain = all(w[ids].all() for w, ids in zip(self.widths, (a, b))) and _among(stops, common).all()
        if not plain or b"".join(self.a_bytes[a]) != raw or b"".join(self.b_bytes[b]) != raw:
            for word in words:
                self._align_one(word)
            return
        to_a, to_b = np.searchsorted(a_ends, common) + 1, np.searchsorted(b_ends, common) + 1
        groups = zip([0, *to_a[:-1].tolist()], to_a.tolist(), [0, *to_b[:-1].tolist()], to_b.tolist())
        shown = self._shown(a, b, groups)
        pairs = a[to_a - 1] * _B_IDS + b[to_b - 1]
        at = [np.searchsorted(ends, stops, side="right") for ends in (a_ends, b_ends, common)]
        per_word = [np.diff(x, prepend=0) for x in at]
        first = len(self.shown)
        self.index.update(zip(words, range(first, first + len(words))))
        self.held += len(text)
        cuts = [0, *at[2].tolist()]
        self.shown += [";".join(shown[x:y]) for x, y in zip(cuts, cuts[1:])]
        for column, values in zip(self.columns, (np.ones(len(words), np.int64), *per_word, per_word[2], len(self.pairs) + at[2])):
            column.frombytes(values.astype(np.int64).tobytes())
        self.pairs.frombytes(pairs.tobytes())

    def texts(self, texts):
        """(measures, groups, pairs, times, first pair) of texts: a row of measures each, groups None where a text is not spelled.

        The pairs of text i and how often each is linked are those from first[i] to first[i + 1].
        """
        if len(self.shown) > REMEMBERED_WORDS or self.held > REMEMBERED_CHARS:
            self.clear()
        words = [(self.words.split(t) if self.piecewise else [t]) if t else [] for t in texts]
        new = dict.fromkeys(w for ws in words for w in ws if w not in self.index)
        together = [w for w in new if self.piecewise and self.edges.fullmatch(w)]
        if together:
            self._align_all(together)
        for w in new:
            if w not in self.index:
                self._align_one(w)
        sizes = np.array([len(ws) for ws in words], dtype=np.int64)
        at = np.fromiter((self.index[w] for ws in words for w in ws), np.int64, int(sizes.sum()))
        row = np.repeat(np.arange(len(texts)), sizes)
        spelled, *measures, ends = (np.frombuffer(c, np.int64) for c in self.columns) if len(self.shown) else [np.zeros(0, np.int64)] * 6
        good = np.bincount(row, 1 - spelled[at], minlength=len(texts)) == 0 if len(at) else np.ones(len(texts), bool)
        good &= sizes > 0
        at, row = at[good[row]], row[good[row]]
        totals = [np.bincount(row, m[at], minlength=len(texts)).astype(np.int64) for m in measures]
        links = measures[3][at]
        first = np.repeat(ends[at] - links - (np.cumsum(links) - links), links)
        pairs = np.frombuffer(self.pairs, np.int64)[first + np.arange(len(first))] if len(first) else first
        keys, times = np.unique((np.repeat(row, links) << _PAIR_BITS) | pairs, return_counts=True)
        starts = np.searchsorted(keys, np.arange(len(texts) + 1) << _PAIR_BITS)
        shown = [None] * len(texts)
        cuts = np.searchsorted(row, np.arange(len(texts) + 1)).tolist()
        names = list(map(self.shown.__getitem__, at.tolist()))
        for i in np.flatnonzero(good):
            shown[i] = ";".join(names[cuts[i] : cuts[i + 1]])
        return np.stack(totals, axis=1), shown, keys & ((1 << _PAIR_BITS) - 1), times, starts


@functools.lru_cache(maxsize=2)
def _aligner(a_content, b_content):
    return Aligner(a_content, b_content)


def _shared(spark, path):
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def aligned_texts(texts, a_path, b_path, keep=(), with_groups=False):
    """``keep`` columns of ``texts`` with the measures, the digest of the groups and the links of ``text``.

    ``pairs`` and ``times`` hold the distinct linked pairs of the text and how often each is
    linked.  ``with_groups`` adds the groups themselves (``a1,a2|b1;a3|b2,b3``).
    """
    a_shared, b_shared = _shared(texts.sparkSession, a_path), _shared(texts.sparkSession, b_path)
    n = len(keep)

    def work(batches):
        aligner = _aligner(a_shared.value, b_shared.value)
        for batch in batches:
            at = 0
            for part in portions(batch.column(n)):
                measures, groups, pairs, times, first = aligner.texts(part.to_pylist())
                digests = ["" if g is None else hashlib.sha256(g.encode()).hexdigest() for g in groups]
                columns = [batch.column(k).slice(at, len(part)) for k in range(n)]
                columns += [pa.array(c, pa.int64()) for c in measures.T]
                first = pa.array(first, pa.int32())
                columns += [pa.array(digests, pa.string()), *(pa.ListArray.from_arrays(first, pa.array(v, pa.int64())) for v in (pairs, times))]
                if with_groups:
                    columns.append(pa.array([g or "" for g in groups], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=names)
                at += len(part)
        # The worker lives on and may serve other steps.
        aligner.clear()

    names = [*keep, *MEASURES, "groups_sha256", "pairs", "times", *(["groups"] if with_groups else [])]
    kinds = [f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in keep]
    schema = [*kinds, *(f"{c} bigint" for c in MEASURES), "groups_sha256 string, pairs array<bigint>, times array<bigint>"]
    if with_groups:
        schema.append("groups string")
    return texts.select(*[F.col(f"`{c}`") for c in keep], "text").mapInArrow(work, ", ".join(schema))


def pair_counts(aligned):
    """(pair, links, best): the links of each id pair in all copies, and whether no pair with its id of B has more."""
    zipped = F.explode(F.arrays_zip("pairs", "times")).alias("p")
    counts = aligned.select(zipped, "copies").groupBy(F.col("p.pairs").alias("pair")).agg(F.sum(F.col("p.times") * F.col("copies")).alias("links"))
    return counts


def _with_best(counts):
    b = F.col("pair") % _B_IDS
    most = counts.groupBy(b.alias("_b")).agg(F.max("links").alias("_most"))
    return counts.withColumn("_b", b).join(most, "_b").select("pair", "links", (F.col("links") == F.col("_most")).alias("best"))


def link_table(aligned, save):
    """(a_id, b_id, links, best) of every linked id pair, over all copies of all texts."""
    return _with_best(save(pair_counts(aligned))).select(
        F.floor(F.col("pair") / _B_IDS).alias("a_id"), (F.col("pair") % _B_IDS).alias("b_id"), "links", "best"
    )


def _scored(aligned, counts, common_pairs, save):
    """(key, n_best, count_sum) of each text with links: frequent pairs by lookup, all others by a join."""
    top = counts.orderBy(F.desc("links"), "pair").limit(common_pairs).toArrow()
    order = np.argsort(top.column("pair").to_numpy())
    shared = aligned.sparkSession.sparkContext.broadcast(
        (top.column("pair").to_numpy()[order], top.column("links").to_numpy()[order], top.column("best").to_numpy(zero_copy_only=False)[order].astype(np.int64))
    )

    def work(batches):
        known, links, best = shared.value
        for batch in batches:
            out = ([], [], [], [])
            for pairs, times in zip(batch.column(1), batch.column(2)):
                pairs, times = pairs.values.to_numpy(), times.values.to_numpy()
                at = np.minimum(np.searchsorted(known, pairs), max(0, len(known) - 1))
                found = known[at] == pairs if len(known) else np.zeros(len(pairs), bool)
                out[0].append(int((times * best[at] * found).sum()) if len(known) else 0)
                out[1].append(int((times * links[at] * found).sum()) if len(known) else 0)
                out[2].append(pairs[~found])
                out[3].append(times[~found])
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], longs), pa.array(out[3], longs)],
                names=["text_key", "n_best", "count_sum", "pairs", "times"],
            )

    looked = save(
        aligned.where("n_links > 0").select("text_key", "pairs", "times").mapInArrow(work, "text_key string, n_best bigint, count_sum bigint, pairs array<bigint>, times array<bigint>")
    )
    rest = looked.where(F.size("pairs") > 0).select("text_key", F.explode(F.arrays_zip("pairs", "times")).alias("p"))
    rest = rest.select("text_key", F.col("p.pairs").alias("pair"), F.col("p.times").alias("n")).join(counts, "pair")
    rest = rest.select("text_key", (F.col("best").cast("long") * F.col("n")).alias("n_best"), (F.col("links") * F.col("n")).alias("count_sum"))
    both = looked.select("text_key", "n_best", "count_sum").unionByName(rest)
    return both.groupBy("text_key").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def align(docs, a_path, b_path, save, key="doc_id", text="text", common_pairs=COMMON_PAIRS):
    """``key`` and the measures of the alignment of every row's whole text.

    n_a, n_b: tokens; n_groups, n_links: groups and links; n_best: links whose pair no
    other pair with its id of B exceeds; count_sum: links of the whole table that hold
    the pair, summed over the links of the text; groups_sha256: digest of the groups.
    """
    rows = docs.select(F.col(f"`{key}`").alias("_id"), F.col(f"`{text}`").alias("text"))
    # The count combines copies before the shuffle by full text.
    texts = rows.where("text <> ''").groupBy("text").agg(F.count("*").alias("copies"))
    texts = texts.select("text", "copies", F.sha2("text", 256).alias("text_key"))
    aligned = save(aligned_texts(texts, a_path, b_path, keep=("text_key", "copies")))
    counts = save(_with_best(save(pair_counts(aligned))))
    found = aligned.select("text_key", *MEASURES, "groups_sha256").join(_scored(aligned, counts, common_pairs, save), "text_key", "left")
    measures = [*MEASURES, "n_best", "count_sum"]
    joined = rows.select("_id", F.when(F.col("text") != "", F.sha2("text", 256)).alias("text_key")).join(found, "text_key", "left")
    return joined.select(
        F.col("_id").alias(key), *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in measures], F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256")
    )
