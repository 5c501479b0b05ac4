"""Registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadtide.llm import (
    binary_codes,
    curriculum,
    decontaminate,
    doubling,
    language,
    minhash,
    prefix_trie,
    suffix_dedup,
    token_count,
    token_pack,
    url_cascade,
    warc,
    whitening,
)
from leadtide.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

END_ID = 1
SEPARATOR = 49407
#: The rules of the URL query.
URL_RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), minhash.THREE_WORDS)


ORACLES["op1_minhash_dedup"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[k:k + 2], ' ')) AS g
  FROM d, unnest(range(1, greatest(len(w) - 1, 2))) u(k) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS seen FROM documents UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.seen),
m AS (SELECT id, min(seen) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id::BIGINT AS component_id, d.doc_id = component_id AS kept
FROM d JOIN m ON m.id = d.doc_id LEFT JOIN n USING (doc_id)
"""


@query
def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary_codes.near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLES["op2_embedding_dedup"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = len(embedding)
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.9),
r AS (SELECT vec_id AS id, vec_id AS seen FROM embeddings UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.seen),
m AS (SELECT id, min(seen) AS component_id FROM r GROUP BY id),
n AS (SELECT a, count(*) AS n_links FROM e GROUP BY a)
SELECT id AS vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id::BIGINT AS component_id, id = component_id AS kept
FROM m LEFT JOIN n ON n.a = m.id
"""


@query
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# Two windows of 13 tokens with two replaced share four in a row, so runs of four find all.
ORACLES["op3_decontaminate"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM benchmark),
w AS (SELECT item_id, t, len(t) AS n, least(13, len(t)) AS w, CASE WHEN len(t) < 13 THEN 0 ELSE 2 END AS s
      FROM i WHERE len(t) >= 5),
dg AS (SELECT doc_id, k AS dk, t[k:k+3] AS g FROM d, unnest(range(1, len(t) - 2)) u(k)),
ig AS (SELECT item_id, k AS ik, t[k:k+3] AS g FROM w, unnest(range(1, len(t) - 2)) u(k)),
c AS (SELECT DISTINCT doc_id, item_id, dk - ik AS shift FROM dg JOIN ig USING (g)),
x AS (SELECT doc_id, item_id, shift, k, w.w, w.s, (d.t[k + shift] = w.t[k])::INT AS same
      FROM c JOIN d USING (doc_id) JOIN w USING (item_id), unnest(range(1, w.n + 1)) u(k)
      WHERE k + shift BETWEEN 1 AND len(d.t)),
z AS (SELECT doc_id, item_id, w, s,
        sum(same) OVER (PARTITION BY doc_id, item_id, shift ORDER BY k ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS hits,
        count(*) OVER (PARTITION BY doc_id, item_id, shift ORDER BY k ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS seen
      FROM x)
SELECT DISTINCT doc_id, item_id FROM z WHERE seen >= w AND hits >= w - s
"""


@query
def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = curriculum.taken(table(spark, sf_dir, "documents"), ["doc_id"])
    return mixed.selectExpr(
        "row.doc_id", "size", "source_size", "target", "taken", "round(first_position, 2) AS first_position"
    )


ORACLES["op4_mix"] = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(doc_id || ':17'), 1, 15))::BIGINT AS turn
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 0.2 WHEN 1 THEN 0.0 ELSE -0.5 END::DOUBLE AS tilt
  FROM d GROUP BY source),
c AS (
  SELECT *, (3 * source_size)::DOUBLE AS cap, sum(source_size) OVER ()::DOUBLE AS total,
    coalesce(sum((3 * source_size)::DOUBLE) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
    sum(weight) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
  FROM s),
l AS (
  SELECT max(CASE WHEN (total - capped) / open_weight * weight <= cap THEN (total - capped) / open_weight END) AS level
  FROM c),
t AS (SELECT source, source_size, tilt, least(cap, coalesce(level * weight, cap)) AS target FROM c, l),
z AS (SELECT sum(target) AS total, sum(target * tilt) AS leaning FROM t),
p AS (
  SELECT d.*, t.source_size, t.target, t.tilt,
    CASE WHEN t.source_size = 0 THEN 0 ELSE floor(t.target / t.source_size)::BIGINT END AS passes,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY turn, doc_id, size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (
  SELECT *, passes + CASE WHEN size > 0 AND before + size / 2 < target - passes * source_size THEN 1 ELSE 0 END AS copies,
    least(1, (before + size / 2) / target) AS u FROM p),
w AS (
  SELECT *, CASE WHEN tilt = 0 THEN u
    ELSE ((1 + tilt) - sqrt(greatest((1 + tilt) * (1 + tilt) - 4 * tilt * u, 0))) / (2 * tilt) END AS moment FROM q)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken,
  CASE WHEN copies > 0 THEN round(total * moment + leaning * (moment - moment * moment), 2) END AS first_position
FROM w, z
"""


@query
def op5_token_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_pack.write(table(spark, sf_dir, "documents"), tokenizer_path(), END_ID)
    return token_pack.read_documents(spark, path)


@query
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeated(table(spark, sf_dir, "documents"))


@query
def op7_doubling_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubling.remove_repeated(table(spark, sf_dir, "documents"))


ORACLES["op7_doubling_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, k, md5(array_to_string(w[k:k + 19], ' ')) AS h FROM d, unnest(range(1, len(w) - 18)) u(k)),
l AS (SELECT doc_id, k FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, k) AS place FROM x) WHERE place > 1),
y AS (SELECT doc_id, k, w[k] AS word FROM d, unnest(range(1, len(w) + 1)) u(k)),
z AS (
  SELECT y.*, coalesce(max(l.k) OVER (PARTITION BY y.doc_id ORDER BY y.k ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0) > 0 AS gone
  FROM y LEFT JOIN l ON l.doc_id = y.doc_id AND l.k = y.k),
g AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY k) FILTER (NOT gone) AS kept FROM z GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_count.write_flat(table(spark, sf_dir, "documents"), tokenizer_path(), SEPARATOR)
    return token_count.count_documents(spark, path, SEPARATOR)


@query
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.predict(docs, language.training_rows(docs), keep=["doc_id"])
    return found.select(
        "doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"
    )


@query
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_cascade.judge(table(spark, sf_dir, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


ORACLES["op9_url_filter"] = r"""
WITH r AS (SELECT * FROM (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'),
                                 ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')) v(verdict, h, p)),
u AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN url[instr(url, '://') + 3:] ELSE '' END AS rest FROM pages),
a AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
m AS (
  SELECT page_id, max_by({'rule': h || p, 'verdict': verdict}, len(h || p)) AS best
  FROM a JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT a.page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict
FROM a LEFT JOIN m USING (page_id)
"""


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = prefix_trie.rebuilt(table(spark, sf_dir, "conversations"))
    return prefix_trie.nodes(paths)


#: CRC-32 of the decimal digits, bit by bit.
CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
  lambda x, y: list_reduce(list_prepend(xor(x, y), range(8)), lambda a, b: xor(a >> 1, (a & 1) * 3988292384))))"""
ORACLES["op11_prefix_trie"] = f"""
WITH o AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
      substr(sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32)) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {CRC32} % 9 AS h FROM (SELECT DISTINCT conv_id FROM o)),
r AS (
  SELECT c.conv_id, o.k, o.role, o.text, 0 AS own FROM c JOIN o ON o.conv_id = c.base AND o.k <= c.h
  UNION ALL
  SELECT c.conv_id, o.k, o.role, o.text, 1 FROM c JOIN o ON o.conv_id = c.conv_id AND o.k > c.h),
t AS (
  SELECT conv_id, row_number() OVER w AS d, strlen(text)::BIGINT AS bytes,
    sha256(string_agg(sha256(role || chr(0) || text), '') OVER (w ROWS UNBOUNDED PRECEDING)) AS node
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY own, k)),
p AS (
  SELECT conv_id, d, bytes, node, lag(node, 1, 'root') OVER (PARTITION BY conv_id ORDER BY d) AS parent,
    d = max(d) OVER (PARTITION BY conv_id) AS ends FROM t
  UNION ALL
  SELECT conv_id, 0, 0, 'root', NULL, conv_id NOT IN (SELECT conv_id FROM t) FROM c),
n AS (
  SELECT node, any_value(parent) AS parent, any_value(d)::BIGINT AS depth, min(conv_id)::BIGINT AS conv_id,
    count(*)::BIGINT AS n_convs, any_value(bytes) AS bytes,
    coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '') AS ids
  FROM p GROUP BY node),
k AS (SELECT parent AS node, count(*)::BIGINT AS n_children FROM n WHERE parent IS NOT NULL GROUP BY parent),
s AS (
  SELECT p.node, sum((n.n_convs - 1) * n.bytes)::BIGINT AS saved_tokens,
    count(*) FILTER (n.node NOT IN (SELECT node FROM k))::BIGINT AS n_leaves
  FROM n JOIN p ON p.conv_id = n.conv_id AND p.d <= n.depth GROUP BY p.node)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children,
  s.n_leaves, s.saved_tokens, sha256(n.ids) AS ends_sha256
FROM n JOIN s USING (node) LEFT JOIN k USING (node) LEFT JOIN n u ON u.node = n.parent
"""


@query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whiten(table(spark, sf_dir, "embeddings"), ["vec_id"])
    return rows.select(
        "row.vec_id", "component", "n", F.col("deviation").try_cast("bigint").alias("deviation"),
        "whitened", "explained", "identity_error",
    )


@query
def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write(table(spark, sf_dir, "pages"))
    return warc.read_pages(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op13_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
m AS (SELECT *, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS holder FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      ((('0x' || substr(hex, (i // 4 * 5 + 1)::INT, 5))::BIGINT >> (15 - i % 4 * 5)::INT) & 31)::INT + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = holder THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> holder THEN holder END AS refers_to
FROM m
"""
