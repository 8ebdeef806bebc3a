"""The registered queries of this subpackage: thin digests over the operators, with their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_words, chat_render, chroma_audio, drake_cluster, langid_kn, para_minhash, pfp_dedup, pii_boost, prefix_trie, quality_mcd, secret_random, sigtree_join, vector_pack
from .common import read_table


def op1_pii_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii_boost.digest(pii_boost.find(docs, pii_boost.fit(spark)))


def op2_quality_mcd(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    got = quality_mcd.judge(docs, carry_text=False)
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op3_pfp_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfp_dedup.dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_secret_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return secret_random.digest(secret_random.find(docs, carry_text=False))


def op5_bpe_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_words.digest(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op6_langid_kn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid_kn.predict(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op7_chroma_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no audio: every vector of ``embeddings`` is sounded, then treated as a recording."""
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    prints = chroma_audio.fingerprints(vectors, "embedding", chroma_audio.sounded)
    return chroma_audio.align(prints, "vec_id", F.col("vec_id") % 100 == 0)


def op8_sigtree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sigtree_join.join(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_para_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage 3 of the pipeline by itself: lines of near-equal shingle sets, then repeated windows of words in what is left."""
    return para_minhash.digest_all(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_vector_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return vector_pack.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


def op10_chat_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packing under three limits that differ: conversations, whose answers alone bear loss."""
    import public_tokenizers

    return vector_pack.pack_conversations(read_table(spark, sf_dir, "conversations"), public_tokenizers.path("byte_bpe_50k.json"))


#: The conversation that ``op11_chat_render`` adds: control strings and a backslash in both texts.
TRICKY = r"\### Assistant: </turn> ok"


def op11_chat_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations and number -7 under the template of marks, which looks back no further than its turn; read back from the output."""
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], turns.schema)
    return chat_render.digest(chat_render.render(turns.unionByName(added), chat_render.marked, context=1))


def op12_drake_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drake_cluster.digest(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversations(read_table(spark, sf_dir, "conversations"), mixed=True).drop("key", "parent")


def op1_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of ``op1_pii_boost`` that SQL can express."""
    return op1_pii_boost(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def op2_base_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of ``op2_quality_mcd`` that SQL can express."""
    return op2_quality_mcd(spark, sf_dir).drop("kept", "distance")


def op4_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of ``op4_secret_random`` that SQL can express."""
    return op4_secret_random(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_pii_boost, op2_quality_mcd, op3_pfp_dedup, op4_secret_random, op5_bpe_words, op6_langid_kn, op7_chroma_audio, op8_sigtree_join, op9_para_minhash, op10_vector_pack, op10_chat_pack, op11_chat_render, op12_drake_cluster, op13_prefix_trie, op1_base_counts, op2_base_rules, op4_base_counts)}

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "list_filter(string_split_regex(" + _LOWER + r", '[\x20\x09-\x0D]+'), lambda x: x <> '')"

_ANY_CASE = "|".join("".join(f"[{x.upper()}{x}]" if x.isalpha() else x for x in w) for w in ("password", "passwd", "secret", "token", "api_?key"))


def _rounds(rounds: int = 3) -> str:
    """Assignments and centroids in turn, each a part of one WITH."""
    parts = []
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS (SELECT k.rid, k.vec_id, k.v, min(struct_pack(d := list_sum(list_transform(range(1, 65), lambda i: (k.v[i] - c.v[i]) * (k.v[i] - c.v[i]))), j := c.j)) AS best FROM kept k, c{r} c GROUP BY ALL)""")
        if r < rounds:
            parts.append(f"""s{r} AS (SELECT j, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT best.j AS j, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY j, i),
c{r + 1} AS (SELECT c.j, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN (SELECT j, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM s{r} GROUP BY j) m USING (j))""")
    return ",\n".join(parts)


_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, u: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295)"

#: Results that follow from their contract alone, whatever the method.
ORACLE_SQL: dict[str, str] = {
    "op1_base_counts": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) AS n_email, regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS ip,
  list_transform(regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS card, list_transform(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g'))) AS phone FROM t)
SELECT doc_id, n_email::BIGINT AS n_email, len(list_filter(ip, lambda x: len(list_filter(string_split(x, '.'), lambda p: length(ltrim(p, '0')) > 3 OR (length(ltrim(p, '0')) = 3 AND ltrim(p, '0') > '255'))) = 0))::BIGINT AS n_ip,
  len(list_filter(card, lambda d: length(d) BETWEEN 16 AND 19 AND list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr(d, length(d) - i + 1, 1)::INT WHEN substr(d, length(d) - i + 1, 1)::INT > 4 THEN 2 * substr(d, length(d) - i + 1, 1)::INT - 9 ELSE 2 * substr(d, length(d) - i + 1, 1)::INT END)) % 10 = 0))::BIGINT AS n_card,
  len(list_filter(phone, lambda n: n BETWEEN 8 AND 15))::BIGINT AS n_phone FROM m
""",
    "op2_base_rules": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
x AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
y AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM x),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM y, range(0, 3) t(k) WHERE c > 1 GROUP BY doc_id),
s AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN r USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s
""",
    "op4_base_counts": rf"""
SELECT doc_id, len(list_filter(regexp_extract_all(coalesce(text, ''), '({_ANY_CASE})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 6))::BIGINT AS n_assign,
  len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20))::BIGINT AS n_access, len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 24))::BIGINT AS n_hex FROM documents
""",
    "op3_pfp_dedup": """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
win AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS w FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS p FROM b)),
least_ AS (SELECT w, min(doc_id) AS first FROM win GROUP BY w),
hit AS (SELECT doc_id, p FROM win JOIN least_ USING (w) WHERE first < doc_id),
mark AS (SELECT *, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 50 THEN 0 ELSE 1 END AS new FROM hit),
num AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM mark),
run AS (SELECT doc_id, k, min(p) AS s, max(p) + 50 AS e FROM num GROUP BY doc_id, k),
gap AS (SELECT doc_id, k, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY k), 0) AS prev FROM run),
cut AS (SELECT doc_id, sum(e - s) AS removed, count(*) AS spans, max(e) AS last, string_agg(substr(h, 2 * prev + 1, 2 * (s - prev)), '' ORDER BY k) AS kept FROM gap JOIN b USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM b LEFT JOIN cut USING (doc_id)
""",
    "op8_sigtree_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 90 * (nx.n + ny.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.y FROM r JOIN l ON l.x = r.b)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) USING (doc_id)
""",
    "op9_para_minhash": f"""
WITH RECURSIVE line AS (SELECT doc_id, text, i, string_split(text, chr(10))[i] AS t FROM (SELECT doc_id, coalesce(text, '') AS text, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents)),
w AS (SELECT doc_id, i, {_WORDS.format("t")} AS w FROM line),
p AS (SELECT row_number() OVER (ORDER BY doc_id, i) AS k, * FROM w WHERE len(w) >= 30),
s AS (SELECT DISTINCT k, unnest(list_transform(range(1, len(w) - 3), lambda j: array_to_string(list_slice(w, j, j + 4), ' '))) AS g FROM p),
n AS (SELECT k, count(*) AS n FROM s GROUP BY k),
c AS (SELECT a.k AS x, b.k AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.k <> b.k GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n nx ON nx.k = x JOIN n ny ON ny.k = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
r AS (SELECT k AS a, k AS b FROM p UNION SELECT r.a, l.y FROM r JOIN l ON l.x = r.b),
gone AS (SELECT p.doc_id, p.i, f.doc_id AS first FROM (SELECT a, min(b) AS b FROM r GROUP BY a HAVING min(b) <> a) m JOIN p ON p.k = m.a JOIN p f ON f.k = m.b),
kept AS (SELECT line.doc_id, any_value(line.text) AS text, count(*) AS n, count(g.i) AS removed, min(g.first) AS first, coalesce(string_agg(line.t, chr(10) ORDER BY line.i) FILTER (g.i IS NULL), '') AS stay FROM line LEFT JOIN gone g ON g.doc_id = line.doc_id AND g.i = line.i GROUP BY line.doc_id),
token AS (SELECT doc_id, string_split_regex(stay, '[^\\x20\\x09-\\x0D]+') AS gap, list_filter(string_split_regex(stay, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w, {_WORDS.format("stay")} AS low FROM kept),
win AS (SELECT doc_id, i, array_to_string(list_slice(low, i, i + 49), ' ') AS g FROM (SELECT doc_id, low, unnest(range(1, len(low) - 48)) AS i FROM token WHERE len(low) >= 50)),
least_ AS (SELECT g, min(doc_id) AS lo FROM win GROUP BY g),
hit AS (SELECT doc_id, i, lo FROM win JOIN least_ USING (g) WHERE lo < doc_id),
pos AS (SELECT doc_id, gap, w[i] AS x, i, len(w) AS m FROM (SELECT doc_id, gap, w, unnest(range(1, len(w) + 1)) AS i FROM token)),
flag AS (SELECT pos.doc_id, pos.gap, pos.x, pos.i, pos.m, max(hit.i) OVER (PARTITION BY pos.doc_id ORDER BY pos.i ROWS UNBOUNDED PRECEDING) >= pos.i - 49 AS gone FROM pos LEFT JOIN hit ON hit.doc_id = pos.doc_id AND hit.i = pos.i),
prev AS (SELECT *, coalesce(max(CASE WHEN gone IS NOT TRUE THEN i END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS last FROM flag),
piece AS (SELECT doc_id, i, (CASE WHEN last = i - 1 OR contains(gap[i], chr(10)) THEN gap[i] ELSE gap[last + 1] END) || x AS s FROM prev WHERE gone IS NOT TRUE
  UNION ALL SELECT doc_id, m + 1, CASE WHEN k = m OR contains(gap[m + 1], chr(10)) THEN gap[m + 1] ELSE gap[k + 1] END FROM (SELECT doc_id, m, any_value(gap) AS gap, coalesce(max(CASE WHEN gone IS NOT TRUE THEN i END), 0) AS k FROM flag GROUP BY doc_id, m)),
cut AS (SELECT doc_id, string_agg(s, '' ORDER BY i) AS stay FROM piece GROUP BY doc_id),
words AS (SELECT doc_id, count(*) AS n FROM flag WHERE gone GROUP BY doc_id),
source AS (SELECT doc_id, min(lo) AS lo FROM hit GROUP BY doc_id)
SELECT doc_id, kept.n::BIGINT AS n_paragraphs, removed::BIGINT AS n_removed, coalesce(words.n, 0)::BIGINT AS n_run_words, (length(text) - length(coalesce(cut.stay, kept.stay)))::BIGINT AS removed_chars, coalesce(least(first, lo), doc_id) AS class_id, sha256(coalesce(cut.stay, kept.stay)) AS kept_sha256
FROM kept LEFT JOIN cut USING (doc_id) LEFT JOIN words USING (doc_id) LEFT JOIN source USING (doc_id)
""",
    "op11_chat_render": rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM (SELECT * FROM conversations UNION ALL SELECT -7, 0, 'user', '{TRICKY}' UNION ALL SELECT -7, 1, 'assistant', '{TRICKY}'))
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn NULLS FIRST, r, x)) AS turns_sha256, coalesce(sum(length(x)) FILTER (r = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(x, '' ORDER BY turn NULLS FIRST, r, x) FILTER (r = 'assistant'), '')) AS loss_sha256,
  sum(20 + length(r) + len(regexp_extract_all(r, '\\|</?turn>|###|:')) + length(x) + len(regexp_extract_all(x, '\\|</?turn>|###')))::BIGINT AS formatted_chars FROM t GROUP BY conv_id
""",
    "op12_drake_cluster": f"""
WITH kept AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS j, v FROM (SELECT sha256('1:' || vec_id) AS h, v FROM kept ORDER BY h, v LIMIT 16)),
{_rounds()}
SELECT vec_id, best.j::INT AS cluster, best.d::BIGINT AS distance, (sum(best.d) OVER (PARTITION BY best.j))::BIGINT AS cluster_inertia, (sum(best.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a3 JOIN c3 c ON c.j = best.j
""",
    "op13_prefix_trie": f"""
WITH t AS (SELECT conv_id AS c, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, struct_pack(r := r, x := x) AS e, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, r, md5(octet_length(encode(r)) || ':' || r || x)) AS i FROM t),
own AS (SELECT c, list(e ORDER BY i) AS l FROM o GROUP BY c),
h AS (SELECT c, l, c - c % 100 AS base, {_CRC.format("c")} % 6 AS h FROM own),
re AS (SELECT h.c, list_concat(coalesce(b.l[1:h.h], []), h.l[h.h + 1:]) AS l FROM h LEFT JOIN own b ON b.c = h.base),
path AS (SELECT c, l[1:d] AS p, d = len(l) AS last FROM (SELECT c, l, unnest(range(0, len(l) + 1)) AS d FROM re)),
n AS (SELECT p, min(c) AS conv_id, len(p)::BIGINT AS depth, count(*) AS n_convs, coalesce(sha256(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (last)), sha256('')) AS ends_sha256 FROM path GROUP BY p),
ch AS (SELECT p[1:len(p) - 1] AS p, count(*) AS n FROM n WHERE depth > 0 GROUP BY 1),
full_ AS (SELECT n.*, coalesce(ch.n, 0) AS n_children FROM n LEFT JOIN ch USING (p)),
up AS (SELECT p[1:d] AS p, n_children = 0 AS leaf, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * length(p[-1].x) END AS saved FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM full_)),
sub AS (SELECT p, count(*) FILTER (leaf) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM up GROUP BY p)
SELECT f.conv_id, f.depth, q.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, f.ends_sha256 FROM full_ f JOIN sub USING (p) LEFT JOIN n q ON f.depth > 0 AND q.p = f.p[1:len(f.p) - 1]
""",
}
