"""Entity resolution across documents: profiles, blocking, pair features, decisions, sound clusters, entities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom import lexicons as lx
from threadloom.functions import names as nm
from threadloom.operators.blocks import pairs_within
from threadloom.operators.graph import components
from threadloom.session import StageTables


def profiles(mentions: DataFrame, doc: str = "article_id") -> DataFrame:
    """One row for each cluster or lone mention of a document: all that the document says about one name.

    Input: mention columns with norm (nm.plain_name). profile_id numbers the groups of a document in order of their
    key before names that are no names drop out; the type is the earliest mention's label.
    """
    m = mentions.withColumn("grp", F.coalesce("coref_cluster_id", F.concat(F.lit("solo:"), "mention_id")))
    best = F.max_by(F.struct("text", "norm"), F.struct(F.length("text"), -F.col("start_char"), "mention_id"))
    g = m.groupBy(doc, "grp").agg(
        best.alias("best"), F.min_by("label", F.struct("start_char", "mention_id")).alias("entity_type"), F.sort_array(F.collect_set("text")).alias("surfaces"),
        F.sort_array(F.collect_set("norm")).alias("norm_surfaces"), F.sort_array(F.collect_set("mention_id")).alias("mention_ids"),
    )
    k = F.row_number().over(Window.partitionBy(doc).orderBy("grp")) - 1
    g = g.withColumn("profile_id", F.format_string("%s:p%03d", F.col(doc), k))
    return g.select("profile_id", doc, "entity_type", F.col("best.text").alias("canonical_surface"), F.col("best.norm").alias("normalized"), "surfaces", "norm_surfaces", "mention_ids").where(nm.is_resolvable(F.col("normalized")))


def surname_attachments(p: DataFrame, doc: str = "article_id") -> DataFrame:
    """(short_id, full_id): a person known by surname only joins the one full name of its document with that surname."""
    person = p.where("entity_type = 'PERSON'").withColumns({"last": nm.surname(F.col("normalized")), "n": F.size(nm.words(F.col("normalized")))})
    full = person.where("n > 1").groupBy(doc, "last").agg(F.min("profile_id").alias("full_id"), F.count("*").alias("k")).where("k = 1")
    return person.where("n = 1").join(full, [doc, "last"]).select(F.col("profile_id").alias("short_id"), "full_id")


def attach_surnames(p: DataFrame, doc: str = "article_id") -> DataFrame:
    """p with every attached surname-only profile folded into its full name's: sets and mentions are united."""
    at = surname_attachments(p, doc)
    sets = [c for c in ("surfaces", "norm_surfaces", "mention_ids", "roles", "orgs", "countries", "topics", "events") if c in p.columns]
    more = p.join(at, F.col("profile_id") == F.col("short_id")).groupBy("full_id").agg(*[F.flatten(F.collect_list(c)).alias(f"more_{c}") for c in sets])
    rest = p.join(at.select(F.col("short_id").alias("profile_id")), "profile_id", "left_anti").join(more, F.col("profile_id") == F.col("full_id"), "left")
    united = {c: F.when(F.col("full_id").isNull(), F.col(c)).otherwise(F.sort_array(F.array_union(c, f"more_{c}"))) for c in sets}
    return rest.withColumns(united).select(*p.columns)


def profile_contexts(p: DataFrame, mentions: DataFrame, sentences: DataFrame, documents: DataFrame, doc: str = "article_id", text: str = "text", length: int = lx.CONTEXT) -> DataFrame:
    """(profile_id, context): the sentences that a profile's mentions stand in, each once and in order, cut to a length."""
    m = p.select("profile_id", F.explode("mention_ids").alias("mention_id")).join(mentions.select("mention_id", F.col(doc).alias("__d"), "sentence_index"), "mention_id")
    m = m.where("sentence_index >= 0").select("profile_id", "__d", "sentence_index").distinct()
    s = sentences.select(F.col(doc).alias("__sd"), F.col("idx").alias("__i"), F.col("start").alias("__s"), F.col("end").alias("__e"))
    s = m.join(s, (F.col("__d") == F.col("__sd")) & (F.col("sentence_index") == F.col("__i"))).join(documents.select(F.col(doc).alias("__td"), F.col(text).alias("__t")), F.col("__d") == F.col("__td"))
    # a sentence longer than the whole context is cut before it is gathered
    said = F.substring("__t", F.col("__s") + 1, F.least(F.col("__e") - F.col("__s"), F.lit(length)))
    g = s.groupBy("profile_id").agg(F.sort_array(F.collect_list(F.struct("__i", said.alias("said")))).alias("x"))
    return g.select("profile_id", F.substring(F.array_join(F.transform("x", lambda x: x["said"]), " "), 1, length).alias("context"))


def context_similarity(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """pairs with raw: the cosine of both sides' unit vectors (profile_id, embedding), 0 where a side has none."""
    side = lambda s: vectors.select(F.col("profile_id").alias(f"{s}_id"), F.col("embedding").alias(f"__{s}"))
    j = pairs.join(side("left"), "left_id", "left").join(side("right"), "right_id", "left")
    return j.withColumn("raw", F.coalesce(nm.cosine(F.col("__left"), F.col("__right")), F.lit(0.0))).drop("__left", "__right")


def blocks(p: DataFrame) -> DataFrame:
    return p.select("profile_id", F.explode(nm.blocking_keys(F.col("normalized"), F.col("entity_type"))).alias("key"))


def oversized_blocks(b: DataFrame, size: int = 200, top: int = 5) -> DataFrame:
    """The largest blocks above a size; a report, so cut to its top."""
    return b.groupBy("key").agg(F.countDistinct("profile_id").alias("n")).where(F.col("n") > size).orderBy(F.desc("n"), "key").limit(top)


def candidate_pairs(b: DataFrame, max_block: int | None = None) -> DataFrame:
    """(left_id, right_id), left_id < right_id, of profiles that share a key; blocks above max_block are left to their
    members' finer keys if a maximum is given. Large blocks are paired in cells, so no task gets a whole one."""
    b = b.distinct()
    if max_block:
        b = b.join(b.groupBy("key").agg(F.count("*").alias("__n")).where(F.col("__n") <= max_block).select("key"), "key")
    p = pairs_within(b.select("key", "profile_id"), "key", "profile_id")
    return p.where("profile_id < profile_id2").select(F.col("profile_id").alias("left_id"), F.col("profile_id2").alias("right_id")).distinct()


def blocking_report(p: DataFrame, pairs: DataFrame) -> DataFrame:
    """Profiles, all pairs, pairs generated, and the reduction in per cent."""
    n = p.agg(F.count("*").alias("profiles")).withColumn("k", F.lit(1))
    g = pairs.agg(F.count("*").alias("generated")).withColumn("k", F.lit(1))
    r = n.join(g, "k").withColumn("all_pairs", F.expr("profiles * (profiles - 1) div 2"))
    return r.select("profiles", "all_pairs", "generated", F.round(F.when(F.col("all_pairs") > 0, 100 * (1 - F.col("generated") / F.col("all_pairs"))).otherwise(0.0), 4).alias("reduction"))


def _numbered_in_order(df: DataFrame, order: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """df in range partitions with __p, its partition, and __k, its place there; and (__q, rows, __first) per partition.

    The numbered rows are written once: a range exchange that is planned twice may draw other bounds the second time.
    """
    parts = max(1, df.sparkSession.sparkContext.defaultParallelism)
    s = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    s = s.withColumns({"__p": F.spark_partition_id(), "__k": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    s = StageTables(df.sparkSession, name).write(s, "numbered")
    return s, s.groupBy(F.col("__p").alias("__q"))


def context_rank(pairs: DataFrame, raw: str, ties: str = "position") -> DataFrame:
    """pairs with context: the rank of the raw similarity over the whole batch, 0 to 1.

    ties 'position' ranks by (raw, left_id, right_id), as results must match; 'neutral' gives equal values one rank.
    The rank is global: range-sorted partitions are numbered from their counts, so no task holds all pairs.
    """
    first = Window.orderBy("__q").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each partition
    sums = {"__first": F.coalesce(F.sum("__n").over(first), F.lit(0)), "__all": F.sum("__n").over(Window.partitionBy())}
    if ties == "neutral":
        s, by = _numbered_in_order(pairs.groupBy(F.col(raw).alias("__raw")).agg(F.count("*").alias("__m")), ["__raw"], "ranks")
        n = by.agg(F.sum("__m").alias("__n")).withColumns(sums)
        inside = Window.partitionBy("__p").orderBy("__k").rowsBetween(Window.unboundedPreceding, -1)
        s = s.withColumn("__in", F.coalesce(F.sum("__m").over(inside), F.lit(0))).join(F.broadcast(n), F.col("__p") == F.col("__q"))
        j = pairs.join(s.select("__raw", "__all", (F.col("__first") + F.col("__in")).alias("__before")), F.col(raw).eqNullSafe(F.col("__raw")))
        rank = F.col("__before") / (F.col("__all") - 1)
    else:
        s, by = _numbered_in_order(pairs, [raw, "left_id", "right_id"], "ranks")
        n = by.agg(F.count("*").alias("__n")).withColumns(sums)
        j = s.join(F.broadcast(n), F.col("__p") == F.col("__q"))
        rank = (F.col("__first") + F.col("__k")) / (F.col("__all") - 1)
    return j.withColumn("context", F.when(F.col("__all") > 1, rank).otherwise(0.5)).select(*pairs.columns, "context")


#: Feature -> the sets that it compares.
SETS = {"alias": "norm_surfaces", "role": "roles", "org": "orgs", "country": "countries"}
#: What features are made of.
PROFILE = ("profile_id", "entity_type", "normalized", "norm_surfaces", "roles", "orgs", "countries", "published_at")


def _with_parts(p: DataFrame) -> DataFrame:
    """What features are made of, with the parts of names and the bits of sets: taken once a profile, not once a pair."""
    p = p.select(*PROFILE, nm.words(F.col("normalized")).alias("words"), nm.acronym(F.col("normalized")).alias("acronym"))
    return p.withColumns({f"{c}_bits": nm.bits(F.col(c)) for c in ("words", *SETS.values())})


def _l(c: str) -> Column:
    return F.col(f"left_{c}")


def _r(c: str) -> Column:
    return F.col(f"right_{c}")


def met_pairs(p: DataFrame, only: Callable[[Callable, Callable], Column] | None = None) -> DataFrame:
    """The candidate pairs of p with what features are made of, as left_* and right_*; only gives a
    condition from the two sides' columns.

    A pair that shares several keys is made in the block of the least of them alone, so pairs are never made distinct,
    never shuffled and never joined with their profiles.
    """
    own = nm.blocking_keys(F.col("normalized"), F.col("entity_type"))
    keys = F.array_sort(F.array_distinct(F.flatten(F.collect_list(own).over(Window.partitionBy("profile_id")))))
    p = _with_parts(p).withColumn("__keys", keys)
    cols = p.columns[:-1]
    b = p.select(*[F.col(c).alias(f"left_{c}") for c in cols], "__keys", F.posexplode("__keys").alias("__i", "__key"))
    b = b.withColumn("left_before", F.slice("__keys", 1, F.col("__i"))).drop("__keys", "__i")
    r = lambda c: F.col(f"left_{c}2")
    first = (F.size("left_before") == 0) | (F.size(r("before")) == 0) | ~F.arrays_overlap("left_before", r("before"))
    j = pairs_within(b, "__key", "left_profile_id", once=lambda: (only(_l, r) & first) if only else first)
    return j.select(*[_l(c) for c in cols], *[r(c).alias(f"right_{c}") for c in cols]).withColumnsRenamed({"left_profile_id": "left_id", "right_profile_id": "right_id"})


def _may_match(l: Callable[[str], Column], r: Callable[[str], Column]) -> Column:
    """False only for pairs whose score is below a match whatever their spellings, dates and sets hold: from the sizes of
    the sets, which must be without repeats, and from equality of the names."""
    n = lambda c: F.size(c).cast("double")
    most = {k: F.when((F.size(l(c)) > 0) & (F.size(r(c)) > 0), F.least(n(l(c)), n(r(c))) / F.greatest(n(l(c)), n(r(c)))).otherwise(0.0) for k, c in SETS.items()}
    most |= {"name": F.when(l("normalized") == r("normalized"), 1.0).otherwise(max(lx.NAME_SUBSET, lx.NAME_FUZZY)), "temporal": F.lit(1.0), "context": F.lit(0.0)}
    return nm.pair_score(most) > lx.MATCH - 1e-9


def matches(p: DataFrame, fuzzy: bool = True) -> DataFrame:
    """(left_id, right_id, score) of the candidate pairs of p that match, without contexts. Pairs that can't match are
    left out where they meet; all others get every feature."""
    p = p.withColumns({c: F.array_distinct(c) for c in SETS.values()})
    return features(met_pairs(p, _may_match), fuzzy).where("decision = 'match'").select("left_id", "right_id", "score")


def _with_profiles(pairs: DataFrame, p: DataFrame) -> DataFrame:
    p = _with_parts(p)
    side = lambda s: p.select(*[F.col(c).alias(f"{s}_{c}" if c != "profile_id" else f"{s}_id") for c in p.columns])
    return pairs.join(side("left"), "left_id").join(side("right"), "right_id")


def pair_features(pairs: DataFrame, p: DataFrame, fuzzy: bool = True) -> DataFrame:
    """Features, vetoes, score, decision and reason of candidate pairs. p has profile_id, entity_type, normalized,
    norm_surfaces, roles, orgs, countries (arrays) and published_at; pairs may have context."""
    return features(_with_profiles(pairs, p), fuzzy)


def features(j: DataFrame, fuzzy: bool = True) -> DataFrame:
    """pair_features of pairs that have both sides' columns as left_* and right_* (met_pairs), and maybe context."""
    return scored(measured(j, fuzzy))


def measured_pairs(p: DataFrame, max_block: int | None = None, fuzzy: bool = True) -> DataFrame:
    """The candidate pairs of p with their vetoes and features but the context."""
    return measured(_with_profiles(candidate_pairs(blocks(p), max_block), p) if max_block else met_pairs(p), fuzzy)


def measured(j: DataFrame, fuzzy: bool = True) -> DataFrame:
    """Vetoes and features of pairs that have both sides' columns; context stays if it is there."""
    l, r = _l, _r  # noqa: E741
    parts = (l("words"), r("words"), l("acronym"), r("acronym"), l("words_bits"), r("words_bits"))
    both = (F.size(l("countries")) > 0) & (F.size(r("countries")) > 0)
    veto = (
        F.when(l("entity_type") != r("entity_type"), "entity type differs")
        .when((l("entity_type") == "PERSON") & nm.given_name_conflict(l("normalized"), r("normalized"), parts), "given names differ")
        .when(both & ~F.arrays_overlap(l("countries"), r("countries")), "countries differ")
    )
    f = {k: nm.jaccard(l(c), r(c), l(f"{c}_bits"), r(f"{c}_bits")) for k, c in SETS.items()} | {
        "name": nm.name_compatibility(l("normalized"), r("normalized"), fuzzy, parts),
        "temporal": nm.temporal_proximity(l("published_at"), r("published_at")),
    }
    return j.select("left_id", "right_id", *[c for c in ("context",) if c in j.columns], veto.alias("veto"), *[c.alias(k) for k, c in f.items()])


def scored(j: DataFrame) -> DataFrame:
    """Score, decision and reason of measured pairs; without context it counts 0."""
    if "context" not in j.columns:
        j = j.withColumn("context", F.lit(0.0))
    f = {k: F.col(k) for k in lx.WEIGHTS}
    j = j.withColumn("score", F.when(F.col("veto").isNull(), nm.pair_score(f)).otherwise(0.0))
    return j.select("left_id", "right_id", *lx.WEIGHTS, "veto", "score", nm.decision(F.col("score"), F.col("veto").isNotNull()).alias("decision"), nm.explanation(f, F.col("veto")).alias("reason"))


def resolution_stats(decided: DataFrame) -> DataFrame:
    return decided.agg(
        F.count("*").alias("pairs"), F.count_if(F.col("decision") == "match").alias("matches"), F.count_if(F.col("decision") == "review").alias("reviews"),
        F.count_if(F.col("decision") == "no_match").alias("no_matches"), F.count_if(F.col("veto").isNotNull()).alias("vetoes"),
    )


def match_clusters(p: DataFrame, matched: DataFrame) -> DataFrame:
    """(profile_id, root): components of the matches; profiles without a match stand alone."""
    cc = components(matched, "left_id", "right_id").select(F.col("id").alias("profile_id"), "root")
    return p.select("profile_id").join(cc, "profile_id", "left").withColumn("root", F.coalesce("root", "profile_id"))


def sound_clusters(clusters: DataFrame, p: DataFrame) -> DataFrame:
    """clusters with sound; members of an unsound one (types, given names or countries that exclude each other) stand alone.

    Tested on the different signatures of a cluster, not on pairs of members: a cluster of persons is unsound if a
    surname has given names that are no initials of each other.
    """
    j = clusters.join(p.select("profile_id", "entity_type", "normalized", "countries"), "profile_id")
    w = nm.words(F.col("normalized"))
    j = j.withColumns({"last": nm.surname(F.col("normalized")), "given": F.when((F.col("entity_type") == "PERSON") & (F.size(w) > 1), F.get(w, F.lit(0)))})
    by_name = j.groupBy("root", "last").agg(F.collect_set(F.when(F.length("given") > 1, F.col("given"))).alias("full"), F.collect_set(F.when(F.length("given") == 1, F.col("given"))).alias("short"))
    clash = (F.size("full") > 1) | (F.size("short") > 1) | F.exists("short", lambda i: F.exists("full", lambda g: ~g.startswith(i)))
    names = by_name.groupBy("root").agg(F.bool_or(clash).alias("names"))
    kinds = j.groupBy("root").agg((F.countDistinct("entity_type") > 1).alias("kinds"))
    # two country sets that share nothing: the different sets of a cluster, paired in cells
    lists = j.where(F.size("countries") > 0).select("root", F.sort_array("countries").alias("cs")).distinct()
    apart = pairs_within(lists, "root", "cs").where(~F.arrays_overlap("cs", "cs2")).select("root").distinct().withColumn("apart", F.lit(True))
    bad = names.join(kinds, "root").join(apart, "root", "left").select("root", (~(F.col("names") | F.col("kinds") | F.coalesce("apart", F.lit(False)))).alias("sound"))
    return clusters.join(bad, "root").select("profile_id", F.when(F.col("sound"), F.col("root")).otherwise(F.col("profile_id")).alias("root"), "sound")


def numbered_entities(entities: DataFrame) -> DataFrame:
    """entities with entity_id TYPE_00000: numbered from 0 by number of profiles, most first, then by name.

    Numbers run over range partitions, so no task holds all entities.
    """
    e = entities.withColumn("__size", F.negative("profiles"))
    s, by = _numbered_in_order(e, ["__size", "normalized", "root"], "entities")
    first = Window.orderBy("__q").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each partition
    n = by.agg(F.count("*").alias("__n")).withColumn("__first", F.coalesce(F.sum("__n").over(first), F.lit(0)))
    j = s.join(F.broadcast(n), F.col("__p") == F.col("__q"))
    number = F.lpad((F.col("__first") + F.col("__k")).cast("string"), F.greatest(F.lit(5), F.length((F.col("__first") + F.col("__k")).cast("string"))), F.lit("0"))
    return j.select(F.concat_ws("_", "entity_type", number).alias("entity_id"), *entities.columns)


def entities_of(clusters: DataFrame, p: DataFrame, matched: DataFrame | None = None, doc: str = "article_id") -> DataFrame:
    """One row for each cluster with the unions of its members' sets, its dates, and the mean score of its matches."""
    j = clusters.join(p, "profile_id")
    canon = F.max_by("canonical_surface", F.struct(F.size(nm.words(F.col("normalized"))), F.length("normalized"), "normalized", "canonical_surface"))
    union = lambda c: F.sort_array(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    more = [union(c) for c in ("roles", "orgs", "countries", "topics", "events") if c in p.columns]
    if "published_at" in p.columns:
        more += [F.min("published_at").alias("first_seen"), F.max("published_at").alias("last_seen")]
    e = j.groupBy("root").agg(
        canon.alias("canonical_name"), F.min_by("entity_type", "profile_id").alias("entity_type"), union("surfaces"), union("mention_ids"), F.sort_array(F.collect_set(doc)).alias("article_ids"), F.count("*").alias("profiles"), F.min("normalized").alias("normalized"), *more
    )
    if matched is not None:
        s = matched.join(clusters.select(F.col("profile_id").alias("left_id"), "root"), "left_id").groupBy("root").agg(F.avg("score").alias("merge_confidence"))
        e = e.join(s, "root", "left").withColumn("merge_confidence", F.coalesce("merge_confidence", F.lit(1.0)))
    return e.withColumns({"article_count": F.size("article_ids"), "mention_count": F.size("mention_ids")})
