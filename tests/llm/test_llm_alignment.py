import collections
import hashlib
import random

import public_tokenizers
import pytest
from edge_cases import LONG, TEXTS, edge_docs, keep, no_docs
from tokenizers import Tokenizer

from inspectlake.llm import alignment

A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
TOKENIZER = Tokenizer.from_file(A)
TOKENIZER.encode_special_tokens = True


@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner(open(A, "rb").read(), open(B, "rb").read())


def of_one(aligner, text):
    measures, groups, pairs, times, first = aligner.texts([text])
    assert first.tolist() == [0, len(pairs)]
    return groups[0] if groups[0] is None else (*measures[0].tolist(), groups[0], dict(zip(pairs.tolist(), times.tolist())))


def plain(aligner, text):
    """Groups and links of a text, tokenised whole."""
    raw = (" " + text).encode()
    a, b = TOKENIZER.encode(" " + text, add_special_tokens=False).ids, aligner.b.encode(text)
    a_bytes, b_bytes = [aligner.a_bytes[i] for i in a], [aligner.b_bytes[i] for i in b]
    if not text or b"".join(a_bytes) != raw or b"".join(b_bytes) != raw:
        return None
    ends = [[sum(map(len, t[: k + 1])) for k in range(len(t))] for t in (a_bytes, b_bytes)]
    links = [(x, y) for x, e in zip(a, ends[0]) for y, f in zip(b, ends[1]) if e == f]
    cuts = sorted(set(ends[0]) & set(ends[1]))
    groups = []
    for low, high in zip([0, *cuts], cuts):
        of_a, of_b = ([str(i) for i, e in zip(ids, at) if low < e <= high] for ids, at in ((a, ends[0]), (b, ends[1])))
        groups.append(",".join(of_a) + "|" + ",".join(of_b))
    return len(a), len(b), groups, links


def test_a_batch_is_as_its_texts(aligner):
    rng = random.Random(9)
    texts = [None, "", *(" ".join(rng.choice(["ab", "the", "é日", "x\n", "▁", "\tq", "", "wörd"]) for _ in range(rng.randrange(9))) for _ in range(300))]
    measures, groups, pairs, times, first = aligner.texts(texts)
    for i, text in enumerate(texts):
        want = plain(aligner, text) if text else None
        assert (groups[i] is None) == (want is None)
        own = dict(zip(pairs[first[i] : first[i + 1]].tolist(), times[first[i] : first[i + 1]].tolist()))
        links = [x * alignment._B_IDS + y for x, y in want[3]] if want else []
        assert own == dict(collections.Counter(links))
        assert measures[i].tolist() == ([want[0], want[1], len(want[2]), len(links)] if want else [0, 0, 0, 0])


def test_words_align_as_whole_texts_do(aligner):
    assert aligner.piecewise
    rng = random.Random(5)
    letters = "abcdefgorstu  \n\t'é日\U0001f600.,12\x1c\x85\xa0▁<s>|endoftext|"
    for _ in range(1500):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 40)))
        want, got = plain(aligner, text), of_one(aligner, text)
        if want is None:
            assert got is None, text
            continue
        n_a, n_b, groups, links = want
        assert got[:4] == (n_a, n_b, len(groups), len(links)) and got[4] == ";".join(groups), text
        assert dict(got[5]) == dict(collections.Counter(x * alignment._B_IDS + y for x, y in links))


@pytest.mark.parametrize("common", [0, 5, 100_000])
def test_measures_of_every_row(spark, aligner, common):
    extra = [(20, "<|endoftext|> and <s>", "en", "a"), (21, "a ▁ b", "en", "a"), (22, "Short text.", "en", "b")]
    more = spark.createDataFrame([(*r, 0, 0.5, "x", 1, ["y"]) for r in extra], edge_docs(spark).schema)
    rows = alignment.align(edge_docs(spark).unionByName(more), A, B, keep, common_pairs=common).collect()
    whole = {t: plain(aligner, t) for t in {t for _, t, *_ in TEXTS + extra} if t and t != LONG}
    got = of_one(aligner, LONG)
    links = [(p // alignment._B_IDS, p % alignment._B_IDS) for p, n in got[5].items() for _ in range(n)]
    whole[LONG] = (got[0], got[1], got[4].split(";"), links)
    counts = collections.Counter()
    for _, t, *_ in TEXTS + extra:
        if whole.get(t):
            counts.update(whole[t][3])
    most = collections.defaultdict(int)
    for (x, y), n in counts.items():
        most[y] = max(most[y], n)
    want = []
    for i, t, *_ in TEXTS + extra:
        if not whole.get(t):
            want.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = whole[t]
        best = sum(counts[p] == most[p[1]] for p in links)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
        want.append((i, n_a, n_b, len(groups), len(links), best, sum(counts[p] for p in links), digest))
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert sorted(map(str, want)) == sorted(str(tuple(r[n] for n in names)) for r in rows)
    assert whole["<|endoftext|> and <s>"] and not whole["a ▁ b"]


def test_no_rows(spark):
    assert alignment.align(no_docs(spark), A, B, keep).count() == 0


def test_links_of_the_table(spark, aligner):
    rows = spark.createDataFrame([("Short text.", "k", 3)], "text string, text_key string, copies long")
    found = alignment.aligned_texts(rows, A, B, keep=("text_key", "copies"), with_groups=True)
    table = alignment.link_table(found, keep).collect()
    n_a, n_b, groups, links = plain(aligner, "Short text.")
    assert found.first().groups == ";".join(groups)
    assert sorted((r.a_id, r.b_id, r.links) for r in table) == sorted((x, y, 3 * n) for (x, y), n in collections.Counter(links).items())
