"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import chat_repair, filter_audit, language_id, mixing, near_dedup, quality_classifier, quality_rules, quality_sql, sentencepiece_codec, suffix_dedup, topk_search, toxicity, url_filter, vector_codes
from orrery.llm.common import dealt, table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judged(dealt(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance")


def list_entries(pages: DataFrame) -> DataFrame:
    """A dated host list made from the pages' own hosts by rules on their MD5 in hex: the tables hold none.

    A first digit of 0 to 4 blocks a host from 2024-03-01, and then a second digit below 8 allows it again from
    2024-09-01; a third digit of 0 to 2 blocks a domain of three labels from 2024-06-01.
    """
    hosts = pages.select(url_filter.host(F.col("url")).alias("host")).filter("host <> ''").distinct()
    digit = lambda i: F.substring(F.md5("host"), i, 1)
    entry = lambda df, action, day: df.select("host", F.lit(action).alias("action"), F.lit(day).cast("timestamp").alias("listed_at"))
    first = hosts.filter(digit(1) <= "4")
    domains = hosts.filter(F.size(F.split("host", r"\.")) == 3).filter(digit(3) <= "2")
    return entry(first, "block", "2024-03-01").unionByName(entry(first.filter(digit(2) <= "7"), "allow", "2024-09-01")).unionByName(entry(domains, "block", "2024-06-01"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    fetched = F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.col("page_id") * 7919, F.lit(366)) * 86400)
    out = url_filter.evaluated(pages.withColumn("fetched_at", fetched), list_entries(pages))
    return out.select("page_id", "url_host", "listed_host", F.date_format("listed_at", "yyyy-MM-dd").alias("listed_on"), "url_kept")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.classified(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")


def op5_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_repair.repaired(table(spark, sf_dir, "conversations"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.learned(docs)
    return language_id.identified(docs.select("doc_id", "text"), model=model).select("doc_id", "held_out", "lang_pred", "score")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents"), near_dedup.Near(shingle=2))


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_classifier.classified(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece_codec.encoded(docs, sentencepiece_codec.Vocabulary.read(), ("n_tokens", "ids_crc", "round_trip"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audited(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compressed(table(spark, sf_dir, "embeddings"))
    return vector_codes.label_errors(coded).select("vec_id", "code", "error", "label_error", F.lit(vector_codes.books_digest(books)).alias("codebooks_sha256"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.removed(table(spark, sf_dir, "documents"))
    gone = (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed")
    return out.select("doc_id", "n_bytes", gone, F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_quality_rules": op2_quality_rules,
    "op3_url_filter": op3_url_filter,
    "op4_toxicity": op4_toxicity,
    "op5_chat_repair": op5_chat_repair,
    "op6_language_id": op6_language_id,
    "op7_near_dedup": op7_near_dedup,
    "op8_topk_search": op8_topk_search,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_filter_audit": op11_filter_audit,
    "op12_vector_codes": op12_vector_codes,
    "op13_suffix_dedup": op13_suffix_dedup,
}
#: Words and lines of documents, for the SQL twins.
_WORDS = r"list_filter(string_split_regex(TXT, '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def _codes_sql(rounds: int = 4, parts: int = 4, width: int = 16) -> str:
    """Lloyd rounds as common tables: each position's distinct parts d, books b0, b1, ... and what is nearest."""
    near = """a{k} AS MATERIALIZED (SELECT d.pos, d.v, any_value(d.n) AS n, min(CAST(list_inner_product(d.x, d.x) - 2 * list_inner_product(d.x, b.x) + list_inner_product(b.x, b.x) AS BIGINT) * 256 + b.e) AS best
  FROM d JOIN b{k} b ON b.pos = d.pos GROUP BY d.pos, d.v)"""
    step = """m{k} AS MATERIALIZED (SELECT pos, best % 256 AS e, sum(n) AS n, {sums} FROM a{k} GROUP BY pos, best % 256),
b{j} AS MATERIALIZED (SELECT b.pos, b.e, CASE WHEN m.e IS NULL THEN b.x ELSE {means} END AS x FROM b{k} b LEFT JOIN m{k} m ON m.pos = b.pos AND m.e = b.e)"""
    sums = ", ".join(f"sum(n * v[{i}]) AS s{i}" for i in range(1, width + 1))
    means = "[" + ", ".join(f"floor(CAST(m.s{i} AS DOUBLE) / m.n)" for i in range(1, width + 1)) + "]"
    tables = []
    for k in range(rounds):
        tables += [near.format(k=k), step.format(k=k, j=k + 1, sums=sums, means=means)]
    tables.append(near.format(k=rounds))
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT r, vec_id, CAST(i.i AS BIGINT) AS pos, v[i.i * {width} + 1 : (i.i + 1) * {width}] AS v FROM v, range({parts}) i(i)),
d AS MATERIALIZED (SELECT pos, v, CAST(v AS DOUBLE[]) AS x, count(*) AS n FROM p GROUP BY pos, v),
f AS (SELECT r, row_number() OVER (ORDER BY vec_id, v) - 1 AS e FROM v WHERE vec_id IS NOT NULL QUALIFY e < 256),
b0 AS MATERIALIZED (SELECT p.pos, f.e, CAST(p.v AS DOUBLE[]) AS x FROM f JOIN p ON p.r = f.r),
{(","+chr(10)).join(tables)},
c AS (SELECT r, string_agg(lower(lpad(hex(best % 256), 2, '0')), '' ORDER BY p.pos) AS code, CAST(sum(best // 256) AS BIGINT) AS error FROM p JOIN a{rounds} a ON a.pos = p.pos AND a.v = p.v GROUP BY r),
h AS (SELECT sha256(string_agg(array_to_string(list_transform(x, lambda y: CAST(CAST(y AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY pos, e)) AS h FROM b{rounds})
SELECT v.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM v JOIN c ON c.r = v.r, h"""


ORACLES: dict[str, str] = {
    "op2_quality_rules": quality_sql.judged_sql(),
    "op3_url_filter": r"""
WITH p AS (SELECT page_id, regexp_replace(regexp_extract(lower(coalesce(url, '')), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '\.+$', '') AS host,
  TIMESTAMP '2024-01-01' + to_days(CAST((page_id * 7919) % 366 AS INTEGER)) AS fetched FROM pages),
h AS (SELECT DISTINCT host FROM p WHERE host <> ''),
e AS (SELECT host, true AS blocked, TIMESTAMP '2024-03-01' AS since FROM h WHERE substring(md5(host), 1, 1) <= '4'
  UNION ALL SELECT host, false, TIMESTAMP '2024-09-01' FROM h WHERE substring(md5(host), 1, 1) <= '4' AND substring(md5(host), 2, 1) <= '7'
  UNION ALL SELECT host, true, TIMESTAMP '2024-06-01' FROM h WHERE len(string_split(host, '.')) = 3 AND substring(md5(host), 3, 1) <= '2'),
iv AS (SELECT host, blocked, since, lead(since) OVER (PARTITION BY host ORDER BY since) AS til FROM e),
up AS (SELECT host, unnest(list_distinct(list_append(list_transform(range(1, 1 + len(string_split(host, '.'))), lambda k: array_to_string(string_split(host, '.')[len(string_split(host, '.')) - k + 1:], '.')), host))) AS u FROM h),
m AS (SELECT p.page_id, u, since, blocked, row_number() OVER (PARTITION BY p.page_id ORDER BY length(u) DESC) AS r FROM p JOIN up ON p.host = up.host JOIN iv ON iv.host = up.u AND since <= fetched AND (til IS NULL OR fetched < til))
SELECT p.page_id, p.host AS url_host, m.u AS listed_host, strftime(m.since, '%Y-%m-%d') AS listed_on, NOT coalesce(m.blocked, false) AS url_kept FROM p LEFT JOIN m ON p.page_id = m.page_id AND m.r = 1""",
    "op7_near_dedup": r"""
WITH RECURSIVE w AS (SELECT doc_id, WORDS AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i + 1])) END) AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
r AS (SELECT a AS v, a AS t FROM e UNION SELECT r.v, e.b FROM r JOIN e ON e.a = r.t),
c AS (SELECT v, min(t) AS c FROM r GROUP BY v)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(c, doc_id) AS component_id, coalesce(c, doc_id) = doc_id AS kept FROM s LEFT JOIN c ON v = doc_id""".replace(
        "WORDS", _WORDS.replace("TXT", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
    ),
    "op8_topk_search": """
WITH v AS (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.id, q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.id <> c.id AND len(q.e) = len(c.e)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op11_filter_audit": r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, WORDS AS w FROM documents),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS bad FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad,
  {'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w), 'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text),
   'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY text), false)} AS x FROM t LEFT JOIN l ON l.doc_id = t.doc_id),
c AS (SELECT part, x, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM f GROUP BY part, x),
k AS (SELECT part, n, good, bad, (CASE WHEN x.A THEN 'A' ELSE '' END) || (CASE WHEN x.B THEN 'B' ELSE '' END) || (CASE WHEN x.C THEN 'C' ELSE '' END) || (CASE WHEN x.D THEN 'D' ELSE '' END) || (CASE WHEN x.E THEN 'E' ELSE '' END) AS m FROM c),
i(i) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT a.i || b.i || c.i || d.i || e.i AS o FROM i a, i b, i c, i d, i e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
r AS (SELECT part, o, s.s AS step, o[s.s] AS f,
  CAST(sum(CASE WHEN translate(m, o[1:s.s], '') = m THEN n ELSE 0 END) AS BIGINT) AS kept,
  CAST(sum(CASE WHEN contains(m, o[s.s]) AND translate(m, o[1:s.s - 1], '') = m THEN n ELSE 0 END) AS BIGINT) AS removed,
  CAST(sum(CASE WHEN contains(m, o[s.s]) AND translate(m, o[1:s.s - 1], '') <> m THEN n ELSE 0 END) AS BIGINT) AS redundant,
  CAST(sum(CASE WHEN m = o[s.s] THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
  CAST(sum(CASE WHEN contains(m, o[s.s]) AND translate(m, o[1:s.s - 1], '') = m THEN good ELSE 0 END) AS BIGINT) AS good_lost,
  CAST(sum(CASE WHEN contains(m, o[s.s]) AND translate(m, o[1:s.s - 1], '') = m THEN bad ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM k, o, range(1, 6) s(s) GROUP BY part, o, s.s)
SELECT part, o AS filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM r""".replace(
        "WORDS", _WORDS.replace("TXT", "coalesce(text, '')")
    ),
    "op12_vector_codes": _codes_sql(),
    "op13_suffix_dedup": r"""
WITH t AS (SELECT doc_id, row_number() OVER () AS r, encode(coalesce(text, '')) AS b, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT r, h, unnest(range(octet_length(b) - 399)) AS p FROM t WHERE octet_length(b) >= 400),
w AS (SELECT r, p, md5(substring(h, CAST(2 * p + 1 AS BIGINT), 800)) AS w FROM p),
q AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY w) AS n FROM w) WHERE n > 1),
g AS (SELECT r, p, CASE WHEN p <= lag(p) OVER (PARTITION BY r ORDER BY p) + 400 THEN 0 ELSE 1 END AS new FROM q),
s AS (SELECT r, i, min(p) AS a, max(p) + 400 AS e FROM (SELECT r, p, sum(new) OVER (PARTITION BY r ORDER BY p) AS i FROM g) GROUP BY r, i),
k AS (SELECT r, i, e AS a, coalesce(lead(a) OVER (PARTITION BY r ORDER BY a), 1000000000) AS e FROM s UNION ALL SELECT r, 0, 0, min(a) FROM s GROUP BY r),
x AS (SELECT t.r, string_agg(substring(h, CAST(2 * k.a + 1 AS BIGINT), CAST(2 * (k.e - k.a) AS BIGINT)), '' ORDER BY i) AS rest FROM k JOIN t ON t.r = k.r GROUP BY t.r),
n AS (SELECT r, CAST(sum(e - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM s GROUP BY r)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, CASE WHEN rest IS NULL THEN sha256(b) ELSE sha256(unhex(rest)) END AS kept_sha256
FROM t LEFT JOIN x ON x.r = t.r LEFT JOIN n ON n.r = t.r""",
}
