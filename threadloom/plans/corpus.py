"""Queries over articles and documents: ingestion, cleaning, segmentation, lexicon scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom import lexicons as lx
from threadloom.functions import text as tx
from threadloom.operators import ingest, segment
from threadloom.plans.tables import read


def _raw(spark, sf_dir):
    return read(spark, sf_dir, "articles", "article_id", "title", "source", "published_at", "body", "collected_at")


def ingest_status(spark, sf_dir):
    s = ingest.with_status(_raw(spark, sf_dir), ["collected_at"])
    return s.select("article_id", F.unix_micros("collected_at").alias("collected_us"), F.array_join("reasons", "; ").alias("reasons"), "status")


def ingest_stats(spark, sf_dir):
    return ingest.ingestion_stats(ingest.with_status(_raw(spark, sf_dir), ["collected_at"]), ["source"])


def article_ids(spark, sf_dir):
    a = read(spark, sf_dir, "articles", "url", "source", "title", "collected_at")
    return a.select("url", "title", tx.article_id(F.col("url"), F.col("source"), F.col("collected_at"), F.col("title")).alias("made_id")).distinct()


def fingerprints(spark, sf_dir):
    d = read(spark, sf_dir, "documents", "doc_id", "text", "n_chars").where("text is not null")
    return d.select("doc_id", F.sha2("text", 256).alias("sha256"), (F.length("text") != F.col("n_chars")).alias("length_differs"))


def plain_documents(spark, sf_dir):
    d = read(spark, sf_dir, "documents", "doc_id", "text").where("text is not null")
    return d.select("doc_id", F.sha1(tx.plain_text(F.col("text"))).alias("clean_sha1"))


def clean_documents(spark, sf_dir):
    """Full cleaning of every article's body: markup, Unicode form, punctuation, citations, blanks."""
    a = read(spark, sf_dir, "articles", "article_id", "body").distinct()
    return a.select("article_id", F.sha1(tx.clean_text(F.col("body"))).alias("clean_sha1"))


def url_domains(spark, sf_dir):
    return read(spark, sf_dir, "articles", "url").groupBy(tx.domain(F.col("url")).alias("domain")).agg(F.count("*").alias("articles"))


def page_titles(spark, sf_dir):
    a = read(spark, sf_dir, "articles", "article_id", "title", "source").where("title is not null and source is not null").distinct()
    return a.select("article_id", tx.page_title(F.col("title"), F.col("source")).alias("page_title"))


def sentences(spark, sf_dir):
    s = segment.sentences(read(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")
    return s.select(F.col("id").alias("doc_id"), F.col("idx").cast("long").alias("idx"), F.col("start").cast("long").alias("start_at"), F.col("end").cast("long").alias("end_at"))


def sentence_stats(spark, sf_dir):
    n = sentences(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n"))
    d = read(spark, sf_dir, "documents", "doc_id", "lang").join(n, "doc_id")
    return d.groupBy("lang").agg(F.count("*").alias("documents"), F.sum("n").alias("sentences"), F.round(F.avg("n"), 6).alias("mean_sentences"))


def sentence_chunks(spark, sf_dir):
    s = segment.sentences(read(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")
    return segment.chunks(s).select(F.col("id").alias("doc_id"), "chunk", "start", "end")


def lexicon_spans(spark, sf_dir):
    """Role titles and topics in every document."""
    d = read(spark, sf_dir, "documents", "doc_id", "text")
    parts = [segment.scan(d, "doc_id", "text", segment.alternation(p), True).withColumn("label", F.lit(label)) for p, label in ((lx.ROLES, "ROLE"), (lx.TOPICS, "TOPIC"))]
    u = parts[0].unionByName(parts[1])
    return u.select(F.col("id").alias("doc_id"), F.col("start").cast("long").alias("start_at"), F.col("end").cast("long").alias("end_at"), "text", "label")


def lexicon_mentions(spark, sf_dir):
    """All five classes of the lexicon, by label and canonical form."""
    m = segment.lexicon_mentions(read(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")
    return m.groupBy("label", "raw_label").agg(F.count("*").alias("mentions"), F.countDistinct("id").alias("documents"))


QUERIES = {f.__name__: f for f in (ingest_status, ingest_stats, article_ids, fingerprints, plain_documents, clean_documents, url_domains, page_titles, sentences, sentence_stats, sentence_chunks, lexicon_spans, lexicon_mentions)}

_STATUS = f"""
WITH r AS (SELECT *, concat_ws('; ', CASE WHEN title IS NULL THEN 'title: missing' END, CASE WHEN source IS NULL THEN 'source: missing' END,
    CASE WHEN published_at IS NULL THEN 'published_at: missing' END, CASE WHEN body IS NULL THEN 'body: missing' END,
    CASE WHEN published_at IS NOT NULL AND NOT coalesce(regexp_full_match(published_at, '{lx.ZONED}') AND try_cast(regexp_replace(published_at, '([+-]\\d{{2}})(\\d{{2}})$', '\\1:\\2') AS TIMESTAMPTZ) IS NOT NULL, false) THEN 'published_at: no time with offset' END) AS reasons FROM articles),
l AS (SELECT *, reasons = '' AND coalesce(length(body) >= {lx.MIN_BODY}, false) AS is_long FROM r),
b AS (SELECT *, coalesce(max(CASE WHEN is_long THEN 1 ELSE 0 END) OVER (PARTITION BY article_id ORDER BY collected_at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l),
s AS (SELECT *, CASE WHEN reasons <> '' THEN 'invalid' WHEN before = 1 THEN 'duplicate' WHEN is_long THEN 'kept' ELSE 'too_short' END AS status FROM b)
"""
_FOLD = lx.PLAIN_SIGNS
_q = lambda s: s.replace("'", "''")
_SENT = f"""
WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(text, '([.!?]+["'')\\]]*)(\\s+)(["''(\\[]*[A-Z0-9])', '\\1' || chr(1) || '\\2\\3', 'g'), '(\\n\\s*\\n)', chr(1) || chr(2) || '\\1', 'g') AS t FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, unnest(string_split(t, chr(1))) AS raw, generate_subscripts(string_split(t, chr(1)), 1) AS k FROM t),
q AS (SELECT *, replace(raw, chr(2), '') AS piece, starts_with(raw, chr(2)) AS hard,
  regexp_replace(lower(regexp_extract(replace(raw, chr(2), ''), '([A-Za-z][A-Za-z.]*?)\\.*[.!?]+["'')\\]]*$', 1)), '\\.+$', '') AS word FROM p),
h AS (SELECT *, length(word) = 1 OR word IN ({", ".join(f"'{a}'" for a in lx.ABBREVIATIONS)}) OR replace(word, '.', '') IN ({", ".join(f"'{a}'" for a in lx.ABBREVIATIONS)}) AS held,
  coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM q),
n AS (SELECT *, CASE WHEN k > 1 AND lag(held) OVER (PARTITION BY doc_id ORDER BY k) AND NOT hard THEN 0 ELSE 1 END AS opens FROM h),
g AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY k) AS grp FROM n),
j AS (SELECT doc_id, grp, min(pos) AS pos, string_agg(piece, '' ORDER BY k) AS s FROM g GROUP BY 1, 2),
w AS (SELECT doc_id, grp, pos + length(s) - length(ltrim(s, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160))) AS start_at, trim(s, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)) AS sentence FROM j),
sents AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY grp) - 1 AS BIGINT) AS idx, CAST(start_at AS BIGINT) AS start_at, CAST(start_at + length(sentence) AS BIGINT) AS end_at FROM w WHERE sentence <> '')
"""


def _scan_sql(pattern: str, label: str, flags: str = "(?i)") -> str:
    return f"""SELECT doc_id, start_at, start_at + length(text) AS end_at, text, '{label}' AS label FROM (
  SELECT doc_id, raw, CAST(coalesce(sum(length(replace(raw, chr(2), ''))) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_at, replace(raw, chr(2), '') AS text FROM (
    SELECT doc_id, unnest(string_split(t, chr(1))) AS raw, generate_subscripts(string_split(t, chr(1)), 1) AS k FROM (
      SELECT doc_id, regexp_replace(text, '{flags}({_q(pattern)})', chr(1) || chr(2) || '\\1' || chr(1), 'g') AS t FROM documents WHERE text IS NOT NULL))) WHERE starts_with(raw, chr(2))"""


def _lexicon_sql() -> str:
    plain = lambda p: segment.alternation(p).replace("\\ ", " ").replace("\\-", "-")
    of = lambda m: "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in m.items()) + "}"
    parts = [
        (plain([*lx.COUNTRIES, *lx.COUNTRY_ALIASES]), "COUNTRY", "", "'GAZ_COUNTRY'"),
        (plain(lx.DEMONYMS), "MISC", "", f"'GAZ_DEMONYM:' || ({of(lx.DEMONYMS)})[text]"),
        (plain(lx.ROLES), "ROLE", "(?i)", "'GAZ_ROLE'"),
        (segment.EVENT, "EVENT", "", "'PAT_EVENT'"),
        (plain(lx.TOPICS), "TOPIC", "(?i)", f"'GAZ_TOPIC:' || coalesce(({of(lx.TOPICS)})[text], ({of(lx.TOPICS)})[lower(text)], '')"),
    ]
    each = " UNION ALL ".join(f"SELECT doc_id, label, {raw} AS raw_label FROM ({_scan_sql(p, label, flags)})" for p, label, flags, raw in parts)
    return f"SELECT label, raw_label, count(*) AS mentions, count(DISTINCT doc_id) AS documents FROM ({each}) GROUP BY 1, 2"


SQL = {
    "lexicon_mentions": _lexicon_sql(),
    "page_titles": r"""
WITH t AS (SELECT DISTINCT article_id, title, source FROM articles WHERE title IS NOT NULL AND source IS NOT NULL),
p AS (SELECT *, regexp_extract(title, '^(.*\S)\s+(?:[|–—-]|::|»)\s+(\S[^|–—]*)$', 1) AS head, regexp_extract(title, '^(.*\S)\s+(?:[|–—-]|::|»)\s+(\S[^|–—]*)$', 2) AS tail FROM t),
w AS (SELECT *, list_filter(regexp_split_to_array(lower(tail), '[^\p{L}\p{M}\p{N}\p{Pc}]+'), lambda x: x <> '') AS a, list_filter(regexp_split_to_array(lower(source), '[^\p{L}\p{M}\p{N}\p{Pc}]+'), lambda x: x <> '') AS b FROM p)
SELECT article_id, CASE WHEN head <> '' AND list_has_any(a, b) THEN head ELSE title END AS page_title FROM w""",
    "ingest_status": _STATUS + "SELECT article_id, epoch_us(collected_at) AS collected_us, reasons, status FROM s",
    "ingest_stats": _STATUS
    + "SELECT source, count(*) AS seen, count(*) FILTER (status = 'kept') AS kept, count(*) FILTER (status = 'invalid') AS invalid, count(*) FILTER (status = 'duplicate') AS duplicates, count(*) FILTER (status = 'too_short') AS too_short FROM s GROUP BY 1",
    "article_ids": "SELECT DISTINCT url, title, 'art_' || substr(sha1(CASE WHEN coalesce(url, '') <> '' THEN url ELSE concat_ws('|', source, strftime(collected_at AT TIME ZONE 'UTC', '%Y-%m-%d'), title) END), 1, 12) AS made_id FROM articles",
    "fingerprints": "SELECT doc_id, sha256(text) AS sha256, length(text) <> n_chars AS length_differs FROM documents WHERE text IS NOT NULL",
    "plain_documents": f"""
WITH f AS (SELECT doc_id, replace(replace(translate(text, '{_q("".join(_FOLD))}​‌‍﻿­', '{_q("".join(_FOLD.values()))}'), '—', ' - '), '…', '...') AS t FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, regexp_replace(t, '\\[(?:\\d{{1,3}}|[a-z]|citation needed|note \\d+)\\]', '', 'gi') AS t FROM f),
s AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '[ \\t\\r\\f\\v]+', ' ', 'g'), '[ \\t]*\\n[ \\t]*', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g') AS t FROM c)
SELECT doc_id, sha1(trim(t, ' ' || chr(9) || chr(10) || chr(13))) AS clean_sha1 FROM s""",
    "url_domains": "SELECT coalesce(nullif(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)', 1), '^www\\.', ''), ''), 'unknown') AS domain, count(*) AS articles FROM articles GROUP BY 1",
    "sentences": _SENT + "SELECT doc_id, idx, start_at, end_at FROM sents",
    "sentence_stats": _SENT + "SELECT lang, count(*) AS documents, CAST(sum(n) AS BIGINT) AS sentences, round(avg(n), 6) AS mean_sentences FROM (SELECT doc_id, count(*) AS n FROM sents GROUP BY 1) c JOIN documents USING (doc_id) GROUP BY 1",
    "lexicon_spans": _scan_sql(segment.alternation(lx.ROLES).replace("\\ ", " "), "ROLE") + " UNION ALL " + _scan_sql(segment.alternation(lx.TOPICS).replace("\\ ", " ").replace("\\-", "-"), "TOPIC"),
}
