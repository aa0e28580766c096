"""Questions to the graph, as lazy DataFrames. Values from a caller enter as literals, never as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators.blocks import pairs_within


def find_entity(entities: DataFrame, aliases: DataFrame, name: str, normalized: str | None = None) -> DataFrame:
    """By canonical name or any alias, case aside."""
    n = name.lower()
    a = aliases.where((F.lower("alias") == n) | (F.col("normalized") == (normalized or n))).select("entity_id").distinct().withColumn("by_alias", F.lit(True))
    e = entities.join(a, "entity_id", "left").where((F.lower("canonical_name") == n) | F.coalesce("by_alias", F.lit(False)))
    return e.select("entity_id", "canonical_name", "entity_type", "article_count", "mention_count").distinct().orderBy(F.desc("article_count"), "entity_id")


def search_entities(entities: DataFrame, aliases: DataFrame, part: str) -> DataFrame:
    """Part of a canonical name or a whole alias, case aside."""
    a = aliases.where(F.lower("alias") == part.lower()).select("entity_id").distinct()
    return entities.where(F.contains(F.lower("canonical_name"), F.lit(part.lower()))).select("entity_id").unionByName(a).distinct().join(entities, "entity_id")


def entity_profile(entities: DataFrame, aliases: DataFrame, attributes: DataFrame | None, entity_id: str) -> DataFrame:
    e = entities.where(F.col("entity_id") == entity_id)
    al = aliases.where(F.col("entity_id") == entity_id).groupBy("entity_id").agg(F.sort_array(F.collect_set("alias")).alias("aliases"))
    out = e.join(al, "entity_id", "left")
    if attributes is not None:
        g = attributes.where(F.col("entity_id") == entity_id).groupBy("entity_id", "attr_type").agg(F.sort_array(F.collect_set("value")).alias("v"))
        out = out.join(g.groupBy("entity_id").agg(F.map_from_entries(F.collect_list(F.struct("attr_type", "v"))).alias("attributes")), "entity_id", "left")
    return out


def in_articles_about(articles: DataFrame, entity_mentions: DataFrame, entities: DataFrame, keyword: str, kind: str = "PERSON", text: str = "body") -> DataFrame:
    """Entities of a type in articles whose title or text has a keyword, by number of articles."""
    a = articles.where(F.col("title").ilike(f"%{keyword}%") | F.col(text).ilike(f"%{keyword}%")).select("article_id").distinct()
    m = entity_mentions.join(a, "article_id", "left_semi").select("entity_id", "article_id", "mention_id").distinct()
    g = m.groupBy("entity_id").agg(F.countDistinct("article_id").alias("articles"), F.count("*").alias("mentions"))
    return g.join(entities.where(F.col("entity_type") == kind).select("entity_id", "canonical_name"), "entity_id").orderBy(F.desc("articles"), "canonical_name", "entity_id")


def co_occurring(entity_mentions: DataFrame, entities: DataFrame, entity_id: str | None = None, limit: int | None = 10) -> DataFrame:
    """Entities that share articles with one, most shared first; for all entities if none is named (pairs a < b). An article
    with very many entities is paired in cells."""
    ea = entity_mentions.select("entity_id", "article_id").distinct()
    if entity_id is None:
        p = pairs_within(ea.where("entity_id is not null").select("article_id", "entity_id"), "article_id", "entity_id").withColumnRenamed("entity_id2", "other_id")
        return p.where("entity_id < other_id").groupBy("entity_id", "other_id").agg(F.count("*").alias("shared_articles"))
    mine = ea.where(F.col("entity_id") == entity_id).select("article_id")
    g = ea.where(F.col("entity_id") != entity_id).join(mine, "article_id", "left_semi").groupBy("entity_id").agg(F.count("*").alias("shared_articles"))
    g = g.join(entities.select("entity_id", "canonical_name", "entity_type"), "entity_id").orderBy(F.desc("shared_articles"), "canonical_name", "entity_id")
    return g.limit(limit) if limit else g


def relations_for_entity(edges: DataFrame, entities: DataFrame, entity_id: str, predicate: str | None = None, object_label: str | None = None, min_confidence: float = 0.0) -> DataFrame:
    e = edges.where((F.col("subject_entity_id") == entity_id) & (F.col("confidence") >= min_confidence))
    e = e.where(F.col("predicate") == predicate) if predicate else e
    e = e.where(F.col("object_label") == object_label) if object_label else e
    o = entities.select(F.col("entity_id").alias("object_entity_id"), F.col("canonical_name").alias("object_name"))
    return e.join(o, "object_entity_id", "left").withColumn("object_name", F.coalesce("object_name", "object_value")).orderBy(F.desc("confidence"), F.desc("support_count"), "edge_id")


def organisations_of(edges: DataFrame, entities: DataFrame, entity_id: str) -> DataFrame:
    return relations_for_entity(edges, entities, entity_id).where("object_label = 'ORG' or predicate = 'works_for'")


def entity_graph(edges: DataFrame, entities: DataFrame, entity_id: str) -> DataFrame:
    """Predicate -> its objects."""
    r = relations_for_entity(edges, entities, entity_id)
    return r.groupBy("predicate").agg(F.sort_array(F.collect_list(F.struct("object_name", "confidence", "support_count"))).alias("objects"))


def articles_for_entity(entity_mentions: DataFrame, mentions: DataFrame, articles: DataFrame, entity_id: str) -> DataFrame:
    """Articles that name an entity, with the surfaces used, by date."""
    m = entity_mentions.where(F.col("entity_id") == entity_id).select("mention_id").distinct().join(mentions.select("mention_id", "article_id", "text").distinct(), "mention_id")
    g = m.groupBy("article_id").agg(F.count("*").alias("mentions"), F.array_join(F.sort_array(F.collect_set("text")), ", ").alias("surfaces"))
    return g.join(articles, "article_id").select("article_id", "title", "source", "published_at", "mentions", "surfaces").orderBy("published_at", "article_id")


def low_confidence_relations(relations: DataFrame, articles: DataFrame, threshold: float = 0.6, limit: int = 25) -> DataFrame:
    r = relations.where(F.col("confidence") < threshold).join(articles, "article_id")
    return r.orderBy("confidence", "relation_id").limit(limit)


def relation_evidence(evidence: DataFrame, relations: DataFrame, articles: DataFrame, edge_id: str) -> DataFrame:
    r = evidence.where(F.col("edge_id") == edge_id).join(relations, "relation_id").join(articles, "article_id")
    return r.orderBy("published_at", "relation_id")


def pending_reviews(pairs: DataFrame, limit: int = 25) -> DataFrame:
    return pairs.where("decision = 'review'").orderBy(F.desc("score"), "left_id", "right_id").limit(limit)


def weakly_supported(entities: DataFrame, threshold: float = 0.65) -> DataFrame:
    return entities.where((F.col("merge_confidence") < threshold) & (F.col("article_count") > 1)).orderBy("merge_confidence", "entity_id")


def by_attribute(attributes: DataFrame, entities: DataFrame, attr_type: str, value: str) -> DataFrame:
    a = attributes.where((F.col("attr_type") == attr_type) & (F.lower("value") == value.lower()))
    return a.join(entities, "entity_id").orderBy(F.desc("article_count"), "entity_id")


def resolve_mention(mentions: DataFrame, members: DataFrame) -> DataFrame:
    """(mention_id, resolved): the text of the representative of the mention's cluster, else its own."""
    rep = members.where("is_representative").select("cluster_id", F.col("text").alias("rep"))
    c = members.where("mention_id is not null").select("mention_id", "cluster_id").distinct().join(rep, "cluster_id")
    return mentions.join(c, "mention_id", "left").select("mention_id", F.coalesce("rep", "text").alias("resolved"))


def low_confidence_list(relations: DataFrame, documents: DataFrame, threshold: float, doc: str = "article_id", text: str = "text", length: int = 110) -> DataFrame:
    """Relations below a confidence, least first, with whether coreference took part and the beginning of their evidence."""
    d = documents.select(F.col(doc).alias("__d"), F.col(text).alias("__t"))
    r = relations.where(F.col("confidence") < threshold).join(d, F.col(doc) == F.col("__d"), "left")
    said = F.when(F.col("evidence_start") >= 0, F.substring("__t", F.col("evidence_start") + 1, F.least(F.col("evidence_end") - F.col("evidence_start"), F.lit(length)))).otherwise("")
    via = F.col("subject_via_coref") | F.col("object_via_coref")
    return r.select("relation_id", F.round("confidence", 2).alias("confidence"), "subject_text", "predicate", "object_text", via.alias("via_coref"), F.coalesce(said, F.lit("")).alias("evidence")).orderBy("confidence", "relation_id")


def review_rows(pairs: DataFrame, profiles: DataFrame, length: int = 120) -> DataFrame:
    """Pairs in review with both sides' names and roles, most likely first; an unknown profile is shown by its id."""
    r = pairs.where("decision = 'review'") if "decision" in pairs.columns else pairs
    for s in ("left", "right"):
        p = profiles.select(F.col("profile_id").alias(f"{s}_id"), F.col("canonical_surface").alias(f"{s}_name"), F.array_join(F.sort_array("roles"), ", ").alias(f"{s}_roles"))
        r = r.join(p, f"{s}_id", "left").withColumns({f"{s}_name": F.coalesce(f"{s}_name", f"{s}_id"), f"{s}_roles": F.coalesce(f"{s}_roles", F.lit(""))})
    r = r.select("left_id", "right_id", F.round("score", 3).alias("score"), "left_name", "right_name", "left_roles", "right_roles", F.substring("reason", 1, length).alias("reason"))
    return r.orderBy(F.desc("score"), "left_id", "right_id")


def entity_rows(entities: DataFrame, aliases: DataFrame, attributes: DataFrame, kind: str | None = None) -> DataFrame:
    """The table of entities: names, articles, aliases, roles and countries in one line each, most articles first."""
    e = entities.where(F.col("entity_type") == kind) if kind else entities
    al = aliases.groupBy("entity_id").agg(F.array_join(F.sort_array(F.collect_set("alias")), ", ").alias("aliases"))
    of = lambda t: F.array_join(F.sort_array(F.collect_set(F.when(F.col("attr_type") == t, F.col("value")))), ", ")
    at = attributes.groupBy("entity_id").agg(of("role").alias("roles"), of("country").alias("countries"))
    e = e.select("entity_id", "canonical_name", "entity_type", "article_count", F.round("merge_confidence", 2).alias("merge_confidence"))
    e = e.join(al, "entity_id", "left").join(at, "entity_id", "left").withColumns({c: F.coalesce(c, F.lit("")) for c in ("aliases", "roles", "countries")})
    return e.orderBy(F.desc("article_count"), "entity_id")


def relations_of_mentions(relations: DataFrame, entity_mentions: DataFrame, entity_id: str) -> DataFrame:
    """Relations whose subject is a mention of the entity."""
    m = entity_mentions.where(F.col("entity_id") == entity_id).select(F.col("mention_id").alias("subject_id")).distinct()
    return relations.join(m, "subject_id", "left_semi")


def titles_shown(articles: DataFrame, title: int = 60, body: int = 200) -> DataFrame:
    """Articles as a list shows them: day, title and body cut to a length, size of the body."""
    return articles.select("article_id", F.date_format("published_at", "yyyy-MM-dd").alias("day"), F.substring("title", 1, title).alias("title"), F.substring("body", 1, body).alias("body"), F.length("body").alias("chars"))


def provenance(relations: DataFrame, articles: DataFrame, entity_mentions: DataFrame, entity_id: str, length: int = 160) -> DataFrame:
    """What is believed of an entity and where it is said: triple, confidence, extractor, source and evidence."""
    r = relations_of_mentions(relations, entity_mentions, entity_id).join(articles.select("article_id", "source", F.col("text").alias("__t")), "article_id")
    said = F.when(F.col("evidence_start") >= 0, F.substring("__t", F.col("evidence_start") + 1, F.least(F.col("evidence_end") - F.col("evidence_start"), F.lit(length)))).otherwise("")
    return r.select("subject_text", "predicate", "object_text", F.round("confidence", 2).alias("confidence"), "extractor", "trigger", "source", said.alias("evidence")).orderBy("predicate", F.desc("confidence"), "source")
