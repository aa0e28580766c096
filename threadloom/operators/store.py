"""Tables of the graph: keyed upserts as snapshots, attributes in long form, edges with their evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.names import noisy_or, plain_name, strip_accents
from threadloom.functions.text import short_hash


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new rows and the old ones whose key is not among them."""
    return new.unionByName(old.join(new.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def replace_children(old: DataFrame, new: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """All child rows of the given parents are replaced, others stay."""
    return new.unionByName(old.join(parents.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows without their parent; a null key refers to nothing."""
    return child.where(F.col(child_key).isNotNull()).join(parent.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_anti")


def attributes_long(df: DataFrame, id_col: str, columns: dict[str, str]) -> DataFrame:
    """(id, attr_type, value) from array or scalar columns."""
    types = dict(df.dtypes)
    item = lambda c: F.col(c) if types[c].startswith("array") else F.array(F.col(c).cast("string"))
    each = F.flatten(F.array(*[_tagged(item(c), t) for c, t in columns.items()]))
    return df.select(id_col, F.explode(each).alias("a")).where("a.v is not null").select(id_col, F.col("a.t").alias("attr_type"), F.col("a.v").alias("value")).distinct()


def _tagged(values, tag):
    return F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.struct(F.lit(tag).alias("t"), v.cast("string").alias("v")))


def build_edges(relations: DataFrame, entity_mentions: DataFrame, articles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, evidence): facts of mentions gathered to facts of entities.

    An object that is no entity is told by its text, case and outer blanks aside. Confidence is that of independent
    reports; the object's text is its longest.
    """
    em = entity_mentions.select("mention_id", "entity_id").distinct()
    r = relations.join(em.select(F.col("mention_id").alias("subject_id"), F.col("entity_id").alias("subject_entity_id")), "subject_id")
    r = r.join(em.select(F.col("mention_id").alias("object_id"), F.col("entity_id").alias("object_entity_id")), "object_id", "left")
    r = r.join(articles.select("article_id", "published_at").dropDuplicates(["article_id"]), "article_id")
    r = r.withColumn("object_key", F.coalesce("object_entity_id", F.lower(F.trim("object_text"))))
    r = r.withColumn("edge_id", short_hash("edge_", F.concat_ws("|", "subject_entity_id", "predicate", "object_key")))
    order = F.struct("published_at", "relation_id")
    edges = r.groupBy("edge_id", "subject_entity_id", "predicate", "object_key").agg(
        F.max("object_entity_id").alias("object_entity_id"), F.max_by("object_text", F.struct(F.length("object_text"), "object_text")).alias("object_value"), F.min_by("object_label", order).alias("object_label"),
        noisy_or(F.col("confidence")).alias("confidence"), F.countDistinct("relation_id").alias("support_count"), F.min("published_at").alias("first_seen"), F.max("published_at").alias("last_seen"),
    )
    return edges, r.select("edge_id", "relation_id").distinct()


#: Columns of the stored tables.
SCHEMAS = {
    "articles": "article_id string, title string, source string, published_at timestamp, url string, language string, collected_at timestamp",
    "documents": "article_id string, published_at timestamp, text string, text_sha256 string",
    "sentences": "article_id string, idx int, start int, end int",
    "mentions": "mention_id string, article_id string, start int, end int, text string, label string, raw_label string, score double, sentence_index int, extractor string, coref_cluster_id string",
    "coref_mentions": "article_id string, cluster_id string, start int, end int, text string, form string, is_representative boolean, mention_id string",
    "relations": "relation_id string, article_id string, subject_id string, predicate string, object_id string, subject_text string, object_text string, subject_label string, object_label string, sentence_index int, evidence_start int, evidence_end int, confidence double, evidence_count long, extractor string, trigger string, subject_via_coref boolean, object_via_coref boolean",
    "entities": "entity_id string, canonical_name string, entity_type string, first_seen timestamp, last_seen timestamp, merge_confidence double, article_count int, mention_count int, pipeline_version string",
    "entity_aliases": "entity_id string, alias string, normalized string",
    "entity_attributes": "entity_id string, attr_type string, value string",
    "entity_mentions": "entity_id string, mention_id string, article_id string, confidence double, method string",
    "entity_relations": "edge_id string, subject_entity_id string, predicate string, object_entity_id string, object_value string, object_label string, confidence double, support_count long, first_seen timestamp, last_seen timestamp",
    "entity_relation_evidence": "edge_id string, relation_id string",
    "review_queue": "review_id string, left_profile string, right_profile string, score double, explanation string, status string",
}
#: Keys by which a row of a stored table replaces another.
KEYS = {
    "articles": ["article_id"], "documents": ["article_id"], "sentences": ["article_id", "idx"], "mentions": ["mention_id"], "coref_mentions": ["cluster_id", "start", "end"], "relations": ["relation_id"], "entities": ["entity_id"],
    "entity_aliases": ["entity_id", "alias"], "entity_attributes": ["entity_id", "attr_type", "value"], "entity_mentions": ["entity_id", "mention_id"], "entity_relations": ["edge_id"], "entity_relation_evidence": ["edge_id", "relation_id"], "review_queue": ["review_id"],
}


def conform(df: DataFrame, table: str) -> DataFrame:
    """df with the columns and types of a stored table; a column it lacks is null, others go."""
    have = set(df.columns)
    cols = [c.split(" ", 1) for c in SCHEMAS[table].split(", ")]
    return df.select(*[(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in cols])


def entity_tables(entities: DataFrame, attributes: dict[str, str], method: str = "entity_resolution_v1") -> dict[str, DataFrame]:
    """The stored tables of entities: aliases in normal form, attributes in long form, and which mentions support each.

    entities has surfaces, mention_ids, merge_confidence and the attribute columns (arrays); an article's id is what
    stands before the first colon of a mention's.
    """
    al = entities.select("entity_id", "entity_type", F.explode("surfaces").alias("alias")).distinct()
    al = al.select("entity_id", "alias", plain_name(strip_accents("alias"), F.col("entity_type")).alias("normalized"))
    m = entities.select("entity_id", "merge_confidence", F.explode("mention_ids").alias("mention_id")).distinct()
    m = m.select("entity_id", "mention_id", F.substring_index("mention_id", ":", 1).alias("article_id"), F.col("merge_confidence").alias("confidence"), F.lit(method).alias("method"))
    return {"entity_aliases": al, "entity_attributes": attributes_long(entities, "entity_id", attributes), "entity_mentions": m}


def upsert_reviews(old: DataFrame | None, pairs: DataFrame) -> DataFrame:
    """The review queue after a run: pairs (left_id, right_id, score, reason) are pending, or keep the status that their
    review had; reviews that the run did not find again stay."""
    new = pairs.select(short_hash("rev_", F.concat("left_id", "right_id")).alias("review_id"), F.col("left_id").alias("left_profile"), F.col("right_id").alias("right_profile"), "score", F.col("reason").alias("explanation")).dropDuplicates(["review_id"])
    if old is None:
        return new.withColumn("status", F.lit("pending"))
    kept = old.select("review_id", F.col("status").alias("__status")).dropDuplicates(["review_id"])
    return upsert(old, new.join(kept, "review_id", "left").withColumn("status", F.coalesce("__status", F.lit("pending"))).drop("__status"), ["review_id"])


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in sorted(tables.items()):
        n = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = n if out is None else out.unionByName(n)
    return out
