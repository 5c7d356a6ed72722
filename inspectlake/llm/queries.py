"""One registered query per operation, and SQL for those that SQL can express."""

import public_tokenizers
from pyspark.sql import functions as F

from inspectlake.llm import alignment, bpe, jaccard, langid, lines, main_text, mixing, pii, prefixes, quality, rules, secret_scan, topk
from inspectlake.session import saved

WORD = r"[^\x20\x09-\x0D]+"


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(key="doc_id"):
    """True for the third of ids whose labels teach nothing."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))


def _equal(value):
    return lambda x: x == value


def op1_top_k(spark, sf_dir):
    vectors = saved(topk.integer_vectors(read(spark, sf_dir, "embeddings")), "topk")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0), save=lambda rows: saved(rows, "topk"))


def op2_language_id(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs, save=lambda rows: saved(rows, "langid"))
    found = langid.with_language(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))


def op3_pii_pseudonyms(spark, sf_dir):
    # A deployment passes its own secret; the name of the setting is this library's.
    key = spark.conf.get("spark.inspectlake.pseudonym.key", "example key")
    found = pii.with_pseudonyms(read(spark, sf_dir, "documents").select("doc_id", "text"), key)
    counts = [F.size(F.filter("finds", _equal(kind))).cast("long").alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", "text", *counts)


def op4_ngram_jaccard(spark, sf_dir):
    return jaccard.jaccard_join(read(spark, sf_dir, "documents").select("doc_id", "text"), lambda rows: saved(rows, "jaccard"))


def op5_mix_sources(spark, sf_dir):
    sizes = read(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    mixed = mixing.mix(sizes, save=lambda rows: saved(rows, "mixing"))
    mixed = mixed.withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("n"))))
    return mixed.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def _joined_spans(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op6_secret_scan(spark, sf_dir):
    found = secret_scan.with_secrets(read(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("secrets")

    def count(kind):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = _joined_spans(F.filter(spans, lambda s: s["kind"] != "guess"))
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), count("guess"), F.sha2(base, 256).alias("base_sha256"), _joined_spans(spans).alias("spans")
    )


def op7_quality_classifier(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, read(spark, sf_dir, "labels"), save=lambda rows: saved(rows, "quality"))
    scored = quality.with_quality(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_quality_rules(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    sample = saved(rules.with_counts(rules.sample_of(docs)), "rules")
    order = [name for name, _, _ in rules.plan(sample, rules.MORE_RULES)]
    counted = rules.with_counts(docs)
    failed = F.coalesce(rules.BASE_RULES["few_words"]("text") | rules.BASE_RULES["repeat_words"]("text"), F.lit(False))
    judged = rules.cascade(
        counted.withColumn("base_failed", failed),
        {"base": lambda text: F.col("base_failed")} | rules.MORE_RULES,
        ["base", *order],
    )
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("failed_rule").isNull().alias("kept")
    )


def op9_line_dedup(spark, sf_dir):
    return lines.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"), lambda rows: saved(rows, "lines"))


def op10_byte_bpe(spark, sf_dir):
    return bpe.encode(
        read(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        columns=("n_tokens", "ids_sha256", "decoded_sha256"),
        pattern=public_tokenizers.PATTERN,
    )


def op11_conversation_prefix_trie(spark, sf_dir):
    found = saved(prefixes.paths_of(read(spark, sf_dir, "conversations")), "turns")
    rebuilt = saved(prefixes.with_borrowed_heads(found), "conversations")
    return prefixes.trie(rebuilt, lambda rows: saved(rows, "prefixes"))


def op12_cross_tokenizer_alignment(spark, sf_dir):
    return alignment.align(
        read(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("piece_bpe_32k.model"),
        save=lambda rows: saved(rows, "alignment"),
    )


def op13_html_extraction(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    return main_text.extract(pages, main_text.fit(pages, lambda rows: saved(rows, "pages")))


QUERIES = {f.__name__: f for f in (op1_top_k, op2_language_id, op3_pii_pseudonyms, op4_ngram_jaccard, op5_mix_sources, op6_secret_scan, op7_quality_classifier, op8_quality_rules, op9_line_dedup, op10_byte_bpe, op11_conversation_prefix_trie, op12_cross_tokenizer_alignment, op13_html_extraction)}
ORACLES = {
    "op1_top_k": """
with v as (select vec_id, max(list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint))) as e from embeddings
 where embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 group by vec_id),
s as (select q.vec_id as query_id, c.vec_id as vec_id,
  cast(coalesce(list_sum(list_transform(range(1, least(len(q.e), len(c.e)) + 1), lambda i: q.e[i] * c.e[i])), 0) as bigint) as score
 from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s
qualify rank <= 10""",
    "op8_quality_rules": r"""
with d as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, unnest(ws) as word, unnest(range(len(ws))) as i from (select doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws from d)),
k as (select doc_id, i, lead(word, 7) over o is not null as whole, concat_ws(' ', word, lead(word) over o, lead(word, 2) over o, lead(word, 3) over o,
  lead(word, 4) over o, lead(word, 5) over o, lead(word, 6) over o, lead(word, 7) over o) as k from w window o as (partition by doc_id order by i)),
r as (select doc_id, i from k where whole qualify count(*) over (partition by doc_id, k) > 1),
g as (select doc_id, least(8, coalesce(lead(i) over (partition by doc_id order by i) - i, 8)) as n from r),
rep as (select doc_id, cast(sum(n) as bigint) as n_repeat_words from g group by doc_id),
counted as (select doc_id, count(*) as n_words, cast(sum(length(word)) as bigint) as word_chars from w group by doc_id),
l as (select doc_id, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines
  from (select doc_id, unnest(string_split(t, chr(10))) as line from d) where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id),
f as (select doc_id, t, coalesce(n_words, 0) as n_words, coalesce(word_chars, 0) as word_chars,
  cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols, coalesce(n_lines, 0) as n_lines,
  coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words
  from d left join counted using (doc_id) left join l using (doc_id) left join rep using (doc_id)),
b as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from f)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 not (base_failed or word_chars < 2 * n_words or word_chars > 15 * n_words or 100 * n_symbols > 30 * n_words or 100 * n_dup_lines > 40 * n_lines
  or 2 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > word_chars
  or 100 * (length(t) - length(regexp_replace(t, '!', '', 'g'))) > 50 * n_words
  or 2 * len(regexp_extract_all(t, '\p{L}[^\x20\x09-\x0D]*')) < n_words) as kept
from b""",
    "op4_ngram_jaccard": r"""
with recursive w as (select doc_id, unnest(ws) as word, unnest(range(len(ws))) as i, len(ws) as n
  from (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents)),
k as (select doc_id, n, lead(word, 4) over o is not null as whole, concat_ws(' ', word, lead(word) over o, lead(word, 2) over o, lead(word, 3) over o,
  lead(word, 4) over o) as k, i from w window o as (partition by doc_id order by i)),
s as (select distinct doc_id, k from k where whole or (n < 5 and i = 0)),
sets as (select doc_id, count(k) as size, md5(coalesce(string_agg(k, chr(10) order by k), '')) as key from documents left join s using (doc_id) group by doc_id),
c as (select doc_id, size, min(doc_id) over (partition by key) as class_id, count(*) over (partition by key) as n_copies from sets),
m as (select doc_id, k, size from s join c using (doc_id) where doc_id = class_id),
links as (select a.doc_id as a, b.doc_id as b from m a join m b on a.k = b.k and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id, a.size, b.size
  having 5 * count(*) >= 4 * (a.size + b.size - count(*))),
reach as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a),
groups as (select a, least(a, min(b)) as group_id from reach group by a)
select doc_id, class_id, coalesce(group_id, class_id) as group_id, (select count(*) from links where a = class_id) as n_links, n_copies
from c left join groups on a = class_id""",
    "op11_conversation_prefix_trie": r"""
with turns as (select conv_id, turn, coalesce(role, '') as r, coalesce(text, '') as x from conversations where conv_id is not null),
own as (select conv_id, list({'r': r, 'x': x} order by turn nulls first, r, sha256(length(r) || ':' || r || x)) as own from turns group by conv_id),
crc as (select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as t
  from (select unnest(range(256)) as i)),
h as (select conv_id, own, xor(list_reduce(list_concat([4294967295], list_transform(string_split(cast(conv_id as varchar), ''), lambda x: cast(ascii(x) as bigint))),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 4 as h from own, crc),
built as (select h.conv_id, list_concat(coalesce(base.own[1:h.h], []), h.own[h.h + 1:]) as p from h left join own base on base.conv_id = h.conv_id - h.conv_id % 20),
begins as (select conv_id, p, unnest(range(len(p) + 1)) as depth from built),
nodes as (select p[1:depth] as p, depth, min(conv_id) as conv_id, count(*) as n_convs,
  sha256(coalesce(string_agg(case when len(p) = depth then cast(conv_id as varchar) end, ',' order by conv_id), '')) as ends_sha256 from begins group by p[1:depth], depth),
children as (select p[1:depth - 1] as p, count(*) as n_children from nodes where depth > 0 group by p[1:depth - 1]),
own_terms as (select nodes.p, depth, case when depth = 0 then 0 else (n_convs - 1) * len(regexp_extract_all(nodes.p[depth].x, '[^\x20\x09-\x0D]+')) end as term,
  case when n_children is null then 1 else 0 end as leaf from nodes left join children on nodes.p = children.p),
above as (select p, term, leaf, unnest(range(depth + 1)) as k from own_terms),
sums as (select p[1:k] as p, cast(sum(term) as bigint) as saved_tokens, cast(sum(leaf) as bigint) as n_leaves from above group by p[1:k])
select n.conv_id, n.depth, u.conv_id as parent_conv_id, n.n_convs, coalesce(n_children, 0) as n_children, n_leaves, saved_tokens, n.ends_sha256
from nodes n join sums on n.p = sums.p left join children on n.p = children.p left join nodes u on u.depth = n.depth - 1 and u.p = n.p[1:n.depth - 1]""",
}
