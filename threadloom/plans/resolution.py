"""Queries of entity resolution: blocking, features, decisions, clusters, entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom import lexicons as lx
from threadloom.functions import names as nm
from threadloom.operators import graph
from threadloom.operators import resolution as er
from threadloom.plans.tables import M, mentions, read
from threadloom.session import StageTables


def names(spark, sf_dir):
    """Entities as profiles: their canonical name in normal form, aliases as surfaces."""
    e = read(spark, sf_dir, "entities", "entity_id", "entity_type", "canonical_name", "first_seen")
    al = read(spark, sf_dir, "entity_aliases", "entity_id", "alias").groupBy("entity_id").agg(F.sort_array(F.collect_set(F.lower("alias"))).alias("norm_surfaces"))
    p = e.join(al, "entity_id", "left").withColumn("__n", nm.strip_accents("canonical_name"))
    none = F.array().cast("array<string>")
    return p.select(
        F.col("entity_id").alias("profile_id"), "entity_type", "canonical_name", nm.plain_name(F.col("__n"), F.col("entity_type")).alias("normalized"), F.coalesce("norm_surfaces", none).alias("norm_surfaces"),
        none.alias("roles"), none.alias("orgs"), none.alias("countries"), F.col("first_seen").alias("published_at"),
    )


def plain_names(spark, sf_dir):
    p = names(spark, sf_dir)
    return p.select("profile_id", "normalized", nm.surname(F.col("normalized")).alias("surname"), nm.acronym(F.col("normalized")).alias("acronym"), nm.phonetic_code(nm.surname(F.col("normalized"))).alias("phonetic"))


def blocking_keys(spark, sf_dir):
    return er.blocks(names(spark, sf_dir))


def oversized_blocks(spark, sf_dir):
    return er.oversized_blocks(er.blocks(names(spark, sf_dir)), 20, 5)


def candidate_pairs(spark, sf_dir):
    return er.candidate_pairs(er.blocks(names(spark, sf_dir)))


def blocking_report(spark, sf_dir):
    p = names(spark, sf_dir)
    return er.blocking_report(p, er.candidate_pairs(er.blocks(p)))


def _decided(spark, sf_dir, fuzzy=False):
    return er.features(er.met_pairs(names(spark, sf_dir)), fuzzy)


def pair_features(spark, sf_dir):
    d = _decided(spark, sf_dir)
    return d.select("left_id", "right_id", F.round("name", 6).alias("name"), F.round("alias", 6).alias("alias"), F.round("temporal", 6).alias("temporal"), F.coalesce("veto", F.lit("")).alias("veto"), F.round("score", 6).alias("score"))


def fuzzy_features(spark, sf_dir):
    """The same with likeness of spelling for names that share no tokens."""
    d = _decided(spark, sf_dir, True)
    return d.select("left_id", "right_id", F.round("name", 6).alias("name"), "decision", "reason")


def resolution_stats(spark, sf_dir):
    return er.resolution_stats(_decided(spark, sf_dir))


def context_ranks(spark, sf_dir):
    p = read(spark, sf_dir, "scored_pairs", "left_id", "right_id", F.coalesce("context_similarity", F.lit(0.0)).alias("raw")).distinct()
    p = p.groupBy("left_id", "right_id").agg(F.max("raw").alias("raw"))
    return er.context_rank(p, "raw").select("left_id", "right_id", F.round("context", 9).alias("context"))


def pair_groups(spark, sf_dir):
    """Connected components of matched pairs, by the core's own operator."""
    p = read(spark, sf_dir, "scored_pairs", "left_id", "right_id", "decision").where("decision = 'match'")
    return graph.components(p, "left_id", "right_id")


def resolved_entities(spark, sf_dir):
    """Blocked, scored, matched, split where unsound, and gathered to entities."""
    p = names(spark, sf_dir)
    matched = StageTables(spark, "resolution").write(er.matches(p), "matches")  # used twice
    c = er.sound_clusters(er.match_clusters(p, matched), p)
    q = p.withColumns({"article_id": F.col("profile_id"), "canonical_surface": F.col("canonical_name"), "surfaces": F.col("norm_surfaces"), "mention_ids": F.array("profile_id")})
    e = er.entities_of(c.select("profile_id", "root"), q, matched)
    return e.select("root", "canonical_name", "entity_type", "article_count", F.round("merge_confidence", 6).alias("merge_confidence"), F.array_join("surfaces", " | ").alias("surfaces"))


def _profiles(spark, sf_dir):
    m = mentions(spark, sf_dir).where("label in ('PERSON', 'ORG') and text is not null").withColumnRenamed("start", "start_char")
    return er.profiles(m.withColumn("norm", nm.plain_name(nm.strip_accents("text"), F.col("label"))))


def mention_profiles(spark, sf_dir):
    return _profiles(spark, sf_dir).select("profile_id", "entity_type", "canonical_surface", "normalized", F.size("mention_ids").alias("n_mentions"))


def surname_attachments(spark, sf_dir):
    return er.surname_attachments(_profiles(spark, sf_dir))


def embedding_neighbours(spark, sf_dir):
    """Rescaled cosine of each vector with the next."""
    e = read(spark, sf_dir, "embeddings", "vec_id", "embedding")
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    unit = lambda c: F.transform(c, lambda x: x.cast("double") / F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))))
    return e.join(n, "vec_id").select("vec_id", F.round(nm.cosine(unit(F.col("embedding")), unit(F.col("next"))), 5).alias("likeness"))


QUERIES = {
    f.__name__: f
    for f in (
        plain_names, blocking_keys, oversized_blocks, candidate_pairs, blocking_report, pair_features, fuzzy_features, resolution_stats, context_ranks, pair_groups, resolved_entities, mention_profiles, surname_attachments, embedding_neighbours,
    )
}

_in = lambda xs: ", ".join(f"'{x}'" for x in xs)


def _plain_sql(text: str, kind: str) -> str:
    """plain_name in SQL."""
    t = f"trim(regexp_replace(regexp_replace(lower(strip_accents({text})), '[^\\p{{L}}\\p{{M}}\\p{{N}}\\p{{Pc}}\\p{{Z}}\\s]', ' ', 'g'), '[\\p{{Z}}\\s]+', ' ', 'g'))"
    roles = "|".join(sorted((r.lower() for r in lx.ROLES), key=len, reverse=True))
    person = f"list_filter(string_split(regexp_replace({t}, '^(?:{roles}) +', ''), ' '), lambda x: x <> '' AND x NOT IN ({_in(lx.HONORIFICS)}))"
    person = f"regexp_replace(array_to_string({person}, ' '), '^(?:(?:{'|'.join(lx.TITLE_SHORT)}) )+', '')"
    org = f"list_filter(string_split(regexp_replace({t}, '(?:(?:^| )(?:{'|'.join(lx.ORG_SUFFIXES)}))+$', ''), ' '), lambda x: x <> '')"
    org = f"(SELECT CASE WHEN len(o) > 1 AND len(list_filter(o, lambda x: x NOT IN ({_in(lx.ORG_STOPWORDS)}))) > 0 THEN list_filter(o, lambda x: x NOT IN ({_in(lx.ORG_STOPWORDS)})) ELSE o END FROM (SELECT {org} AS o))"
    return f"CASE WHEN {kind} = 'PERSON' THEN {person} ELSE array_to_string({org}, ' ') END"


_digits = "translate(regexp_replace(s, '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', '01230120022455012623010202')"
for _d in "123456":
    _digits = f"regexp_replace({_digits}, '{_d}+', '{_d}', 'g')"
_CODE = f"CASE WHEN regexp_replace(s, '[^a-z]', '', 'g') <> '' THEN substr(substr(regexp_replace(s, '[^a-z]', '', 'g'), 1, 1) || replace(substr({_digits}, 2), '0', '') || '000', 1, 4) END"
_N = f"""
WITH n0 AS (SELECT entity_id AS profile_id, entity_type, first_seen, {_plain_sql("canonical_name", "entity_type")} AS normalized FROM entities),
n AS (SELECT *, list_filter(string_split(normalized, ' '), lambda x: x <> '') AS w, list_filter(string_split(normalized, ' '), lambda x: x <> '')[-1] AS s FROM n0),
f AS (SELECT *, CASE WHEN len(w) > 1 THEN array_to_string(list_transform(w, lambda x: substr(x, 1, 1)), '') END AS acr, {_CODE} AS code FROM n)
"""
_KEYS = (
    _N.rstrip()
    + """,
k AS (SELECT profile_id, 'full:' || normalized AS key FROM f WHERE normalized <> ''
  UNION SELECT profile_id, 'sur:' || s FROM f WHERE entity_type = 'PERSON' AND normalized <> ''
  UNION SELECT profile_id, 'phon:' || code FROM f WHERE entity_type = 'PERSON' AND normalized <> '' AND code IS NOT NULL
  UNION SELECT profile_id, 'init:' || substr(normalized, 1, 1) || '_' || s FROM f WHERE entity_type = 'PERSON' AND len(w) > 1
  UNION SELECT profile_id, 'tok:' || t FROM (SELECT profile_id, unnest(w) AS t FROM f WHERE entity_type <> 'PERSON') WHERE length(t) > 3
  UNION SELECT profile_id, 'acr:' || acr FROM f WHERE entity_type <> 'PERSON' AND acr IS NOT NULL
  UNION SELECT profile_id, 'acr:' || normalized FROM f WHERE entity_type <> 'PERSON' AND len(w) = 1 AND length(normalized) BETWEEN 2 AND 6),
p AS (SELECT DISTINCT x.profile_id AS left_id, y.profile_id AS right_id FROM k x JOIN k y USING (key) WHERE x.profile_id < y.profile_id)
"""
)
_FEAT = (
    _KEYS.rstrip()
    + f""",
al AS (SELECT entity_id AS profile_id, list(DISTINCT lower(alias)) AS ns FROM entity_aliases WHERE alias IS NOT NULL GROUP BY 1),
g AS (SELECT f.*, coalesce(al.ns, []) AS ns FROM f LEFT JOIN al USING (profile_id)),
j AS (SELECT p.left_id, p.right_id, l.entity_type AS lt, r.entity_type AS rt, l.normalized AS ln, r.normalized AS rn, l.w AS lw, r.w AS rw, l.s AS ls, r.s AS rs, l.acr AS la, r.acr AS ra, l.ns AS lns, r.ns AS rns, l.first_seen AS lf, r.first_seen AS rf
  FROM p JOIN g l ON l.profile_id = p.left_id JOIN g r ON r.profile_id = p.right_id),
h AS (SELECT *, CASE WHEN lt <> rt THEN 'entity type differs' WHEN lt = 'PERSON' AND len(lw) > 1 AND len(rw) > 1 AND ls = rs AND lw[1] <> rw[1] AND NOT (length(lw[1]) = 1 AND starts_with(rw[1], lw[1])) AND NOT (length(rw[1]) = 1 AND starts_with(lw[1], rw[1])) THEN 'given names differ' ELSE '' END AS veto,
  CASE WHEN ln = '' OR rn = '' THEN 0.0 WHEN ln = rn THEN 1.0 WHEN list_has_all(rw, lw) OR list_has_all(lw, rw) OR coalesce(len(lw) = 1 AND length(ln) >= 3 AND ln = ra, false) OR coalesce(len(rw) = 1 AND length(rn) >= 3 AND rn = la, false) THEN {lx.NAME_SUBSET} ELSE 0.0 END AS name,
  CASE WHEN len(lns) > 0 AND len(rns) > 0 THEN len(list_intersect(lns, rns)) / len(list_distinct(lns || rns)) ELSE 0.0 END AS alias,
  coalesce(exp(-abs(epoch_us(lf) - epoch_us(rf)) / 86400e6 / {lx.DECAY_DAYS}), 0.0) AS temporal FROM j),
d AS (SELECT *, CASE WHEN veto = '' THEN {lx.WEIGHTS["name"]} * name + {lx.WEIGHTS["alias"]} * alias + {lx.WEIGHTS["temporal"]} * temporal ELSE 0.0 END AS score FROM h)
"""
)
_PROF = f"""
WITH {M}, q AS (SELECT *, coalesce(coref_cluster_id, 'solo:' || mention_id) AS grp, {_plain_sql("text", "label")} AS norm FROM m WHERE label IN ('PERSON', 'ORG') AND text IS NOT NULL),
g AS (SELECT article_id, grp, max_by(text, (length(text), -"start", mention_id)) AS canonical_surface, max_by(norm, (length(text), -"start", mention_id)) AS normalized, min_by(label, ("start", mention_id)) AS entity_type, count(DISTINCT mention_id) AS n_mentions FROM q GROUP BY 1, 2),
k AS (SELECT *, article_id || ':p' || lpad(CAST(row_number() OVER (PARTITION BY article_id ORDER BY encode(grp)) - 1 AS VARCHAR), 3, '0') AS profile_id FROM g),
pr AS (SELECT *, list_filter(string_split(normalized, ' '), lambda x: x <> '') AS w FROM k WHERE length(normalized) >= 3 AND normalized NOT IN ({_in(lx.NOT_NAMES)}))
"""
SQL = {
    "plain_names": _N + "SELECT profile_id, normalized, s AS surname, acr AS acronym, code AS phonetic FROM f",
    "blocking_keys": _KEYS + "SELECT profile_id, key FROM k",
    "oversized_blocks": _KEYS + "SELECT key, count(DISTINCT profile_id) AS n FROM k GROUP BY 1 HAVING count(DISTINCT profile_id) > 20 ORDER BY n DESC, encode(key) LIMIT 5",
    "candidate_pairs": _KEYS + "SELECT left_id, right_id FROM p",
    "blocking_report": _KEYS + "SELECT n AS profiles, n * (n - 1) // 2 AS all_pairs, g AS generated, round(CASE WHEN n > 1 THEN 100 * (1 - g / (n * (n - 1) // 2)) ELSE 0 END, 4) AS reduction FROM (SELECT (SELECT count(*) FROM f) AS n, (SELECT count(*) FROM p) AS g)",
    "pair_features": _FEAT + "SELECT left_id, right_id, round(name, 6) AS name, round(alias, 6) AS alias, round(temporal, 6) AS temporal, veto, round(score, 6) AS score FROM d",
    "resolution_stats": _FEAT + f"SELECT count(*) AS pairs, count(*) FILTER (score >= {lx.MATCH}) AS matches, count(*) FILTER (score >= {lx.REVIEW} AND score < {lx.MATCH}) AS reviews, count(*) FILTER (score < {lx.REVIEW}) AS no_matches, count(*) FILTER (veto <> '') AS vetoes FROM d",
    "context_ranks": "WITH p AS (SELECT left_id, right_id, max(coalesce(context_similarity, 0.0)) AS raw FROM scored_pairs GROUP BY 1, 2) SELECT left_id, right_id, round(CASE WHEN count(*) OVER () > 1 THEN (row_number() OVER (ORDER BY raw, left_id, right_id) - 1) / (count(*) OVER () - 1) ELSE 0.5 END, 9) AS context FROM p",
    "pair_groups": """
WITH RECURSIVE e AS (SELECT left_id AS a, right_id AS b FROM scored_pairs WHERE decision = 'match' AND left_id <> right_id UNION SELECT right_id, left_id FROM scored_pairs WHERE decision = 'match' AND left_id <> right_id),
reach(v, r) AS (SELECT a, a FROM e UNION SELECT e.b, reach.r FROM reach JOIN e ON e.a = reach.v)
SELECT v AS id, min(r) AS root FROM reach GROUP BY 1""",
    "mention_profiles": _PROF + "SELECT profile_id, entity_type, canonical_surface, normalized, CAST(n_mentions AS INTEGER) AS n_mentions FROM pr",
    "surname_attachments": _PROF
    + "SELECT s.profile_id AS short_id, f.full_id FROM pr s JOIN (SELECT article_id, w[-1] AS last, min(profile_id) AS full_id FROM pr WHERE entity_type = 'PERSON' AND len(w) > 1 GROUP BY 1, 2 HAVING count(*) = 1) f ON f.article_id = s.article_id AND f.last = s.w[-1] WHERE s.entity_type = 'PERSON' AND len(s.w) = 1",
    "embedding_neighbours": "SELECT a.vec_id, round(greatest(0, least(1, (list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) + 1) / 2)), 5) AS likeness FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
}
