import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from edge_cases import TEXTS, edge_docs, no_docs

from inspectlake.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def exact():
    ranks = bpe.read_ranks(open(PATH, "rb").read())
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_same_ids_as_the_exact_encoder(exact):
    codec = bpe.Codec(open(PATH, "rb").read(), public_tokenizers.PATTERN)
    rng = random.Random(3)
    letters = "abcdefgorstu  \n\t'é日\U0001f600.,12\x1c\x85\xa0"
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(40)))
        ids = np.frombuffer(codec.encode(text), "<u4")
        assert ids.tolist() == exact.encode_ordinary(text)
        starts, ends = codec.spans(text, ids)
        assert codec.bytes_of(ids).decode() == text
        assert all(0 <= s < e <= len(text) for s, e in zip(starts, ends))


def test_edge_rows_and_digests(spark, exact):
    rows = bpe.encode(edge_docs(spark), PATH, columns=("ids", "n_tokens", "ids_sha256", "decoded_sha256")).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(t[0]) for t in TEXTS)
    text_of = {t[0]: t[1] or "" for t in TEXTS}
    for r in rows:
        ids = exact.encode_ordinary(text_of[r.doc_id])
        assert (r.ids, r.n_tokens) == (ids, len(ids))
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text_of[r.doc_id].encode()).hexdigest()
    assert bpe.encode(no_docs(spark), PATH).count() == 0


def test_decode_handles_split_characters(spark, exact):
    ids = exact.encode_ordinary("ok \U0001f9ff")
    assert len(ids) > 3
    rows = spark.createDataFrame([(1, ids), (2, ids[:-1]), (3, []), (4, None)], "doc_id long, ids array<int>")
    out = {r.doc_id: (bytes(r.decoded), r.text) for r in bpe.decode(rows, PATH).collect()}
    assert out[1] == ("ok \U0001f9ff".encode(), "ok \U0001f9ff")
    assert out[2][1].startswith("ok ") and out[2][1].endswith("�")
    assert out[3] == out[4] == (b"", "")


def test_offsets(spark):
    rows = spark.createDataFrame([(1, "é日 ab")], "doc_id long, text string")
    r = bpe.encode(rows, PATH).first()
    assert r.starts[0] == 0 and r.ends[-1] == 5 and all(a <= b for a, b in zip(r.starts, r.starts[1:]))
