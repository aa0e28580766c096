"""Problem 10: texts cut off by a field limit or in mid-transfer.

Method: the length of every text is recomputed as it would be under other encodings, entity escaping, JSON
escaping and newline conversion. Grouped by source, a hidden storage limit shows as a narrow heap of one of these
lengths; a limit counted in whole words leaves a heap a word wide. Then the endings are inspected: at a limit a text is
cut unless its ending proves it whole, elsewhere (a transfer that broke off leaves no limit) only unless proved cut.

All of it is built-in expressions; texts are read once, and what is shuffled is counts of lengths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.session import StageTables

# Words that stand for an omission when bracketed, and abbreviations whose full stop ends no sentence.
MORE = "more|read more|continued|mehr|weiter|suite|lire la suite|más|leer más"
ABBREVIATIONS = "No|Nr|Mr|Mrs|Ms|Dr|Prof|St|Hon|Gov|Sen|Gen|Rep|Sr|Sra|Mme|vs|bzw|núm|approx"
#: A limit that leaves whole words shortens a text by less than this.
WORD_SLACK = 24
#: A heap of lengths holds at least so many texts, and so many times what those within NEIGHBOURHOOD of it let expect.
MIN_SPIKE, TIMES_EXPECTED, NEIGHBOURHOOD = 5, 6, 400
#: A heap is a limit if this share of its texts ends unfinished.
UNFINISHED = 0.5
#: A closing line's form is known from so many texts that lie at no limit.
MIN_SIGN_OFFS = 5

MARK = rf"(?i)\s*(?:[\[(]\s*(?:\.\.\.|…|{MORE}|\+?\d+ ?(?:more )?(?:chars|characters|zeichen|caractères|caracteres))\s*(?:\.\.\.|…)?\s*[\])]|…|\.\.\.)$"


MEASURES = (
    "characters", "utf8_bytes", "utf16_units", "characters_crlf", "utf8_bytes_crlf", "characters_entities", "utf8_bytes_entities", "characters_entities_apos", "json_utf8_bytes", "json_characters", "json_ascii",
)


def with_lengths(df: DataFrame, text: str) -> DataFrame:
    """df with lens, the text's length by each way a store may count it, in the order of MEASURES."""
    t = F.col(text)
    count = lambda ch: F.length(t) - F.length(F.replace(t, F.lit(ch), F.lit("")))
    # one pass brings a text down to the characters outside ASCII; what else is asked of them is asked of those
    d = df.withColumns({"__wide": F.regexp_replace(t, r"[\x00-\x7F]++", ""), "__chars": F.length(t), "__bytes": F.octet_length(t)} | {f"__{k}": count(ch) for k, ch in (("lines", "\n"), ("amp", "&"), ("lt", "<"), ("gt", ">"), ("quote", '"'), ("apos", "'"), ("back", "\\"), ("tab", "\t"))})
    # code points beyond the BMP take two UTF-16 units
    d = d.withColumn("__astral", F.length("__wide") - F.length(F.regexp_replace("__wide", r"[\x{10000}-\x{10FFFF}]", "")))
    c = lambda k: F.col(f"__{k}")
    entities = c("amp") * 4 + (c("lt") + c("gt")) * 3 + c("quote") * 5
    json = c("quote") + c("back") + c("lines") + c("tab")
    lens = {
        "characters": c("chars"),
        "utf8_bytes": c("bytes"),
        "utf16_units": c("chars") + c("astral"),
        "characters_crlf": c("chars") + c("lines"),
        "utf8_bytes_crlf": c("bytes") + c("lines"),
        "characters_entities": c("chars") + entities,
        "utf8_bytes_entities": c("bytes") + entities,
        "characters_entities_apos": c("chars") + entities + c("apos") * 5,
        "json_utf8_bytes": c("bytes") + json,
        "json_characters": c("chars") + json,
        "json_ascii": c("chars") - F.length("__wide") + (F.length("__wide") + c("astral")) * 6 + json,
    }
    return d.withColumn("lens", F.array(*[lens[m].cast("int") for m in MEASURES])).select(*df.columns, "lens")


def _endings(documents: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    d = documents.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("src"), F.col(text_col).cast("string").alias("text"))
    blank = " \t\r\n   ​﻿"
    d = d.withColumn("end", F.rtrim(F.col("text"), F.lit(blank))).where("id is not null and end is not null and end <> ''")
    d = d.withColumn("tail", F.trim(F.substring_index("end", "\n", -1)))
    whole = F.regexp_replace("tail", MARK, "")
    d = d.withColumns(
        {
            "mark": F.when(whole == F.col("tail"), "none").when(F.col("tail").rlike(r"[\])]$"), "bracket").otherwise("dots"),
            "said": whole,
            "own_line": F.instr("end", "\n") > 0,
            "words": F.size(F.split("tail", r"\s+")),
        }
    )
    closed = F.col("said").rlike(r"""[.!?。！？]["'”’“»›)\]]*$""") & ~F.col("said").rlike(rf"(?:^|[\s(“„«])(?:{ABBREVIATIONS})\.$")
    few = F.col("words") <= 8
    sign_off = F.col("own_line") & (
        F.col("said").rlike(r"^(?:\(.*\)|\[.*\])$")
        | F.col("said").rlike(r"^[^\p{L}\p{N}]+$")
        | F.col("said").rlike(r"(?i)(?:https?://|www\.)\S+$|\S+@\S+\.\p{L}+$")
        | (few & F.col("said").rlike(r"^(?:[—–]|--?)\s?\p{L}[^.!?;:]*$"))
        | (few & F.col("said").rlike(r"^\p{L}[^.!?:,]{0,30} ?: ?\S[^.!?]*$"))
        | F.col("said").rlike(r"^\p{Lu}{3,}(?: \p{Lu}+){0,3}$")
        | ((F.col("mark") == "dots") & few)
    )
    # the form of a closing line: addresses, numbers and capitalised words stand for any other
    form = F.col("tail")
    for pattern, to in ((r"\S+@\S+|\S+://\S+", "U"), (r"\p{Nd}+", "0"), (r"\p{Lu}[\p{Ll}'’-][\p{L}'’-]*(?:\s+\p{Lu}[\p{Ll}'’-][\p{L}'’-]*)*", "N")):
        form = F.regexp_replace(form, pattern, to)
    d = d.withColumns({"open": ~closed, "sign_off": sign_off}).withColumn("form", F.when(F.col("sign_off"), F.xxhash64(form)))
    return with_lengths(d.select("id", "src", "end", "mark", "open", "sign_off", "form"), "end").drop("end")


def hidden_limits(endings: DataFrame) -> DataFrame:
    """(src, mark, measure, cap, texts, exact): for each source and kind of omission mark every length at which its texts
    heap up, by every measure that shows it; exact counts the texts of just that length.

    The lengths of all texts are counted, complete ones too. A heap is a window of lengths with more texts than its
    neighbourhood lets expect; it is a limit if most of its texts then prove unfinished. A source may have several.
    """
    u = endings.select("src", "mark", (F.col("open") & (~F.col("sign_off") | (F.col("mark") == "dots"))).cast("int").alias("cut"), F.posexplode("lens").alias("m", "v"))
    h = u.groupBy("src", "mark", F.get(F.array(*[F.lit(m) for m in MEASURES]), F.col("m")).alias("measure"), "v").agg(F.count("*").alias("n"), F.sum("cut").alias("cut"))
    w = Window.partitionBy("src", "mark", "measure").orderBy("v")
    heap = w.rangeBetween(1 - WORD_SLACK, 0)
    h = h.withColumns({"texts": F.sum("n").over(heap), "open": F.sum("cut").over(heap), "near": F.sum("n").over(w.rangeBetween(-NEIGHBOURHOOD, NEIGHBOURHOOD))})
    expected = F.col("near") * WORD_SLACK / (2 * NEIGHBOURHOOD + 1)
    h = h.where((F.col("texts") >= MIN_SPIKE) & (F.col("texts") >= TIMES_EXPECTED * expected) & (F.col("open") >= UNFINISHED * F.col("texts")))
    # the fullest window stands for those that overlap it, its end at the length that most texts have
    best = F.max(F.struct("texts", "n", F.negative("v").alias("back"))).over(w.rangeBetween(1 - WORD_SLACK, WORD_SLACK - 1))
    h = h.withColumn("best", best).where(F.col("best.back") == F.negative("v"))
    return h.select("src", "mark", "measure", F.col("v").alias("cap"), "texts", F.col("n").alias("exact"))


def truncated(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, src, cut, at_limit, measure, cap): every row with a text, and whether it stops before its own end.

    Null, empty and blank texts and rows with a null id are left out; a null source is a source of its own;
    repeated rows are judged alike; other columns are ignored. First the lengths tell whether a text lies at a limit of
    its source; then its ending is inspected. At a limit a text is cut unless it ends its sentence, or in a closing
    line (signature, address, link, label with a value, bracketed note, ornament) of a form that texts at no limit
    have. Elsewhere only an ending in mid-sentence or mid-word that is no closing line at all shows a cut.
    """
    # texts are read once; what is kept of each is a few numbers
    e = StageTables(documents.sparkSession, "endings").write(_endings(documents, id_col, text_col, source_col), "endings")
    one = F.struct(F.negative(F.col("texts") + F.col("exact")).alias("rank"), "measure", "cap")
    l = hidden_limits(e).groupBy(F.col("src").alias("l_src"), F.col("mark").alias("l_mark")).agg(F.sort_array(F.collect_list(one)).alias("limits"))
    j = e.join(l, F.col("src").eqNullSafe(F.col("l_src")) & (F.col("mark") == F.col("l_mark")), "left")
    # all limits of a source are tried, the sharpest first; there are at most as many as lengths of texts
    hit = F.get(F.filter("limits", lambda x: F.element_at("lens", F.array_position(F.array(*[F.lit(m) for m in MEASURES]), x["measure"]).cast("int")).between(x["cap"] - WORD_SLACK + 1, x["cap"])), F.lit(0))
    j = j.withColumn("hit", hit)
    j = j.select("id", "src", "mark", "open", "sign_off", "form", F.col("hit.measure").alias("measure"), F.col("hit.cap").alias("cap"), F.col("hit").isNotNull().alias("at_limit"))
    known = j.where("sign_off and not at_limit").groupBy("form").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_SIGN_OFFS).select("form", F.lit(True).alias("known"))
    j = j.join(known, "form", "left")
    cut = F.when(F.col("at_limit"), F.col("open") & ~(F.col("sign_off") & F.coalesce("known", F.lit(False)))).otherwise(F.col("open") & ~F.col("sign_off"))
    return j.select("id", "src", cut.alias("cut"), "at_limit", "measure", "cap")


def _documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")


def p10_found(spark, sf_dir):
    return truncated(_documents(spark, sf_dir)).where("cut").select(F.col("id").alias("doc_id")).distinct()


def p10_by_source(spark, sf_dir):
    """How often each source truncates, and at which limit."""
    t = truncated(_documents(spark, sf_dir))
    return t.groupBy(F.col("src").alias("source")).agg(
        F.count("*").alias("texts"),
        F.count_if("cut").alias("cut_texts"),
        F.round(F.count_if("cut") / F.count("*"), 6).alias("share"),
        F.max(F.when(F.col("cut") & F.col("at_limit"), F.concat_ws(" ", "cap", "measure"))).alias("limit_seen"),
    )


QUERIES = {"p10_found": p10_found, "p10_by_source": p10_by_source}
SQL: dict[str, str] = {}
