"""Relations between mentions: adjacency patterns as one windowed scan, verb frames as joins over a token table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom import lexicons as lx
from threadloom.functions.text import short_hash
from threadloom.session import StageTables


def types_valid(predicate: Column, subject: Column, obj: Column) -> Column:
    """Whether the labels may stand in the predicate; an unknown predicate takes any."""
    ok = F.lit(True)
    for p, (s, o) in lx.ARGUMENTS.items():
        ok = F.when(predicate == p, subject.isin(*s) & obj.isin(*o)).otherwise(ok)
    return ok


def pattern_relations(mentions: DataFrame, between: Column, doc: str = "article_id") -> DataFrame:
    """Relations of neighbouring mentions of a sentence: role and person either way round, demonym before them, role
    of an organisation. between is the trimmed lower-case text from a mention to the next one of its sentence, given
    as a column over mentions with next_ columns (see neighbours())."""
    m = mentions.withColumn("gap", between)
    w = Window.partitionBy(doc, "sentence_index").orderBy("start", "end", "mention_id")
    me = F.struct("mention_id", "text", "label", "raw_label")
    m = m.withColumns(
        {
            "prev": F.lag(me).over(w),
            "prev_gap": F.lag("gap").over(w),
            "next": F.lead(me).over(w),
            "holder": F.last(F.when(F.col("label") == "PERSON", me), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        }
    )
    adjacent, prev_adjacent = F.col("gap").isin(*lx.JOINERS), F.col("prev_gap").isin(*lx.JOINERS)
    role_person = (F.col("label") == "ROLE") & (F.col("next.label") == "PERSON") & adjacent
    country = F.regexp_extract(F.col("prev.raw_label"), r"^GAZ_DEMONYM:(.*)$", 1)

    def rel(s, p, o, conf, trigger, o_text=None, o_label=None):
        g = lambda x, f: F.col(f"{x}.{f}") if x else F.col(f)
        return F.struct(
            g(s, "mention_id").alias("subject_id"), g(s, "text").alias("subject_text"), g(s, "label").alias("subject_label"), F.lit(p).alias("predicate"),
            g(o, "mention_id").alias("object_id"), (o_text if o_text is not None else g(o, "text")).alias("object_text"), (F.lit(o_label) if o_label else g(o, "label")).alias("object_label"),
            F.lit(conf).alias("confidence"), F.lit(trigger).alias("trigger"),
        )

    found = F.array_compact(
        F.array(
            F.when(role_person, rel("next", "holds_position", "", lx.ADJACENT, "role+person")),
            F.when(role_person & (country != "") & prev_adjacent, rel("next", "represents", "prev", lx.ADJACENT, "demonym+role+person", country, "COUNTRY")),
            F.when((F.col("label") == "PERSON") & (F.col("next.label") == "ROLE") & adjacent, rel("", "holds_position", "next", lx.APPOSITIVE, "person+role")),
            F.when((F.col("label") == "ROLE") & (F.col("next.label") == "ORG") & F.col("gap").isin(*lx.OF_JOINERS) & F.col("holder").isNotNull(), rel("holder", "works_for", "next", lx.OF_ORG, "role+of+org")),
        )
    )
    r = m.select(doc, "sentence_index", F.explode(found).alias("r")).select(doc, "sentence_index", "r.*")
    r = r.where(types_valid(F.col("predicate"), F.col("subject_label"), F.col("object_label")) & (F.col("subject_id") != F.col("object_id")))
    return r.withColumn("relation_id", short_hash("rel_", F.concat_ws("|", doc, "subject_id", "predicate", "object_id"))).withColumns({"subject_via_coref": F.lit(False), "object_via_coref": F.lit(False), "extractor": F.lit("patterns")})


def coref_role_relations(mentions: DataFrame, members: DataFrame, doc: str = "article_id") -> DataFrame:
    """A role in a cluster whose representative is a person: the person holds the position."""
    rep = members.where("is_representative and mention_id is not null").select("cluster_id", F.col("mention_id").alias("person_id"))
    p = mentions.where("label = 'PERSON'").select(F.col("mention_id").alias("person_id"), F.col("text").alias("subject_text"))
    role = mentions.where("label = 'ROLE'").join(members.select("mention_id", "cluster_id").distinct(), "mention_id")
    r = role.join(rep, "cluster_id").join(p, "person_id").select(
        doc, "sentence_index", F.col("person_id").alias("subject_id"), "subject_text", F.lit("PERSON").alias("subject_label"), F.lit("holds_position").alias("predicate"), F.col("mention_id").alias("object_id"),
        F.col("text").alias("object_text"), F.lit("ROLE").alias("object_label"), F.lit(lx.APPOSITIVE).alias("confidence"), F.lit("coref+role").alias("trigger"),
    )
    return r.withColumns({"relation_id": short_hash("rel_", F.concat_ws("|", doc, "subject_id", "predicate", "object_id")), "subject_via_coref": F.lit(True), "object_via_coref": F.lit(False), "extractor": F.lit("patterns")})


def with_gaps(mentions: DataFrame, documents: DataFrame, doc: str, text: str) -> DataFrame:
    """mentions with gap: what stands between a mention and the next one of its sentence."""
    w = Window.partitionBy(doc, "sentence_index").orderBy("start", "end", "mention_id")
    m = mentions.withColumn("__next", F.lead("start").over(w)).join(documents.select(F.col(doc).alias("__d"), F.col(text).alias("__t")), F.col(doc) == F.col("__d"))
    return m.withColumn("gap", F.lower(F.trim(F.substring("__t", F.col("end") + 1, F.greatest(F.col("__next") - F.col("end"), F.lit(0)))))).drop("__next", "__d", "__t")


def dependency_frames(tokens: DataFrame, doc: str = "article_id") -> DataFrame:
    """(doc, verb, predicate, subject, object, confidence): who did what to whom, from tokens (doc, i, lemma, pos, dep, head).

    A verb's noun object decides before the verb alone; a negated verb gives nothing; a modal child or head weakens;
    a missing subject is inherited from the head; conjuncts of subjects and objects count as well; a passive verb
    swaps its arguments and needs an agent.
    """
    t = tokens.select(doc, "i", "lemma", "pos", "dep", "head")
    c = t.select(F.col(doc).alias("d"), F.col("head").alias("of"), F.col("i").alias("ci"), F.col("lemma").alias("cl"), F.col("dep").alias("cd")).where("ci <> of")
    nouns = F.create_map(*[F.lit(x) for (v, n), p in lx.VERB_NOUNS.items() for x in (f"{v} {n}", p)])
    verbs = F.create_map(*[F.lit(x) for v, p in lx.VERBS.items() for x in (v, p)])
    v = t.where("pos in ('VERB', 'AUX')").join(c, (F.col(doc) == F.col("d")) & (F.col("i") == F.col("of")), "left")
    objects = ("dobj", "obj", "attr", "oprd", "dative")
    v = v.groupBy(doc, "i", "lemma", "dep", "head").agg(
        F.min(F.when(F.col("cd").isin(*objects), F.element_at(nouns, F.concat_ws(" ", "lemma", "cl")))).alias("by_noun"),
        F.coalesce(F.bool_or(F.col("cd") == "neg"), F.lit(False)).alias("negated"),
        F.coalesce(F.bool_or(F.col("cl").isin(*lx.MODALS)), F.lit(False)).alias("modal_child"),
        F.coalesce(F.bool_or(F.col("cd").isin("nsubjpass", "auxpass")), F.lit(False)).alias("passive"),
    )
    h = t.select(F.col(doc).alias("d"), F.col("i").alias("hi"), F.col("lemma").alias("hl"))
    v = v.join(h, (F.col(doc) == F.col("d")) & (F.col("head") == F.col("hi")) & (F.col("head") != F.col("i")), "left").drop("d", "hi")
    v = v.withColumn("predicate", F.coalesce("by_noun", F.element_at(verbs, F.col("lemma")))).where("predicate is not null and not negated")
    v = v.withColumn("weak", F.col("modal_child") | F.coalesce(F.col("hl").isin(*lx.MODALS), F.lit(False)))

    def children(of: DataFrame, deps, alias):
        return of.join(c.where(F.col("cd").isin(*deps)), (F.col(doc) == F.col("d")) & (F.col("at") == F.col("of"))).select(doc, "i", F.col("ci").alias(alias))

    # the token that each chain of conjuncts hangs on, by doubling until no pointer changes; 32 rounds reach any int, a ring of heads has no end
    keep = StageTables(tokens.sparkSession, "conjuncts")
    up = keep.write(t.select(F.col(doc).alias("ud"), F.col("i").alias("member"), F.when(F.col("dep") == "conj", F.col("head")).otherwise(F.col("i")).alias("top")), "up")
    for k in range(32):
        nxt = up.select(F.col("ud").alias("vd"), F.col("member").alias("vm"), F.col("top").alias("further"))
        j = keep.write(up.join(nxt, (F.col("ud") == F.col("vd")) & (F.col("top") == F.col("vm"))).select("ud", "member", "top", "further"), f"up-{k}")
        up = j.select("ud", "member", F.col("further").alias("top"))
        if j.where("top <> further").isEmpty():
            break

    def conjuncts(args: DataFrame, alias):
        """Arguments with the tokens joined to them."""
        j = args.join(up, (F.col(doc) == F.col("ud")) & (F.col(alias) == F.col("top")))
        return j.select(*[x for x in args.columns if x != alias], F.col("member").alias(alias)).distinct()

    subj_deps = ("nsubj", "nsubjpass")
    own = children(v.withColumn("at", F.col("i")), subj_deps, "s")
    orphan = v.join(own.select(doc, "i").distinct(), [doc, "i"], "left_anti").where("dep in ('conj', 'xcomp', 'advcl', 'ccomp')")
    subjects = conjuncts(own.unionByName(children(orphan.withColumn("at", F.col("head")), subj_deps, "s")), "s")
    direct = conjuncts(children(v.withColumn("at", F.col("i")), objects, "o"), "o").withColumns({"base": F.lit(lx.DIRECT), "agent": F.lit(False)})
    prep = children(v.withColumn("at", F.col("i")), ("prep",), "p").withColumn("at", F.col("p"))
    prep = conjuncts(children(prep, ("pobj",), "o"), "o").withColumns({"base": F.lit(lx.PREPOSITION), "agent": F.lit(False)})
    agent = children(v.withColumn("at", F.col("i")), ("agent",), "p").withColumn("at", F.col("p"))
    agent = children(agent, ("pobj",), "o").withColumns({"base": F.lit(lx.DIRECT), "agent": F.lit(True)})
    obj = direct.unionByName(prep).unionByName(agent)
    r = v.select(doc, "i", "predicate", "weak", "passive").join(subjects, [doc, "i"]).join(obj, [doc, "i"]).where("not passive or agent")
    conf = F.col("base") * F.when(F.col("weak"), lx.MODAL_FACTOR).otherwise(1.0)
    return r.select(doc, F.col("i").alias("verb"), "predicate", F.when(F.col("passive"), F.col("o")).otherwise(F.col("s")).alias("subject"), F.when(F.col("passive"), F.col("s")).otherwise(F.col("o")).alias("object"), conf.alias("confidence"))


def deduplicate(relations: DataFrame, doc: str = "article_id", min_confidence: float = lx.MIN_CONFIDENCE) -> DataFrame:
    """One relation for each (subject, predicate, object) of a document, case and outer blanks aside, with
    evidence_count; the most confident stays, a direct one before one by coreference."""
    key = [doc, F.lower(F.trim("subject_text")), "predicate", F.lower(F.trim("object_text"))]
    w = Window.partitionBy(*key)
    order = w.orderBy(F.desc("confidence"), "subject_via_coref", "extractor", "relation_id")
    r = relations.withColumns({"evidence_count": F.count("*").over(w), "__r": F.row_number().over(order)})
    return r.where(f"__r = 1 and confidence >= {min_confidence}").drop("__r")


def relation_stats(relations: DataFrame) -> DataFrame:
    return relations.groupBy("predicate", "extractor").agg(F.count("*").alias("relations"), F.count_if(F.col("subject_via_coref") | F.col("object_via_coref")).alias("via_coref"))


def relation_problems(relations: DataFrame, mentions: DataFrame, documents: DataFrame | None = None, text: str = "text", doc: str = "article_id") -> DataFrame:
    """(relation_id, problem): relations whose subject or object is no mention, or whose evidence leaves the text."""
    ids = mentions.select(F.col("mention_id").alias("__m")).distinct()
    out = None
    for side in ("subject", "object"):
        lost = relations.join(ids, F.col(f"{side}_id") == F.col("__m"), "left_anti").select("relation_id", F.lit(f"{side} is no mention").alias("problem"))
        out = lost if out is None else out.unionByName(lost)
    if documents is not None and "evidence_end" in relations.columns:
        d = documents.select(F.col(doc).alias("__d"), F.length(text).alias("__n"))
        far = relations.join(d, F.col(doc) == F.col("__d"), "left").where("evidence_start >= 0 and (__n is null or evidence_end > __n)")
        out = out.unionByName(far.select("relation_id", F.lit("evidence outside the text").alias("problem")))
    return out


def with_evidence(relations: DataFrame, mentions: DataFrame, sentences: DataFrame, doc: str = "article_id") -> DataFrame:
    """relations with evidence_start and evidence_end: the sentence that holds the subject, -1 if none does."""
    m = mentions.select(F.col("mention_id").alias("__m"), F.col(doc).alias("__d"), F.col("sentence_index").alias("__i"))
    s = sentences.select(F.col(doc).alias("__sd"), F.col("idx").alias("__si"), F.col("start").alias("evidence_start"), F.col("end").alias("evidence_end"))
    at = m.join(s, (F.col("__d") == F.col("__sd")) & (F.col("__i") == F.col("__si"))).select("__m", "evidence_start", "evidence_end").dropDuplicates(["__m"])
    r = relations.join(at, F.col("subject_id") == F.col("__m"), "left").drop("__m")
    return r.withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("evidence_start", "evidence_end")})
