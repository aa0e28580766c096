"""Problem 5: lines that stand in very many documents of one source.

Method: weighted graphs of consecutive lines. A node is a (source, normalised line) weighted by the number of
different articles it stands in; an edge joins two nodes that follow each other in an article, weighted the same
way. Nodes and edges of high support are kept, connected components of them are the boilerplate blocks, and every
occurrence of a block's line is deleted.

Lines are carried as two independent 64-bit hashes, never as text, so the shuffles stay narrow whatever the
length of the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from threadloom.llm.components import connected_components
from threadloom.operators.blocks import spread_join
from threadloom.session import StageTables

MIN_LETTERS = 20
MIN_ARTICLES = 5


def normal_line(line: Column) -> Column:
    """Lines that agree in this form are the same: lower case, runs of spaces and tabs as one space, none at the
    ends, runs of digits as one 0."""
    c = F.regexp_replace(F.lower(line), r"\p{Nd}+", "0")
    return F.trim(F.regexp_replace(c, r"[ \t]+", " "))


def letters(line: Column) -> Column:
    return F.length(F.regexp_replace(line, r"\P{L}+", ""))


def _eligible(articles: DataFrame, id_col: str, source_col: str, body_col: str, min_letters: int) -> DataFrame:
    """One row for each line that is long enough: id, line_no, place among the eligible lines, node hashes."""
    a = articles.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("src"), F.split(F.col(body_col), "\n", -1).alias("ls")
    ).where("id is not null and src is not null and ls is not null")
    a = a.withColumn("ls", F.transform("ls", lambda x, i: F.struct(i.cast("int").alias("line_no"), x.alias("line"))))
    # the length test comes first as it is cheap; the letters are counted only of lines that pass it
    a = a.withColumn("ls", F.filter("ls", lambda s: (F.length(s["line"]) >= min_letters) & (letters(s["line"]) >= min_letters)))
    x = a.select("id", "src", F.posexplode("ls").alias("place", "s")).select("id", "src", "place", "s.line_no", normal_line(F.col("s.line")).alias("norm"))
    return x.select("id", "line_no", "place", F.xxhash64("src", "norm").alias("k1"), F.xxhash64(F.lit(77), "norm", "src").alias("k2"))


def repeated_lines(
    articles: DataFrame,
    id_col: str = "article_id",
    source_col: str = "source",
    body_col: str = "body",
    min_letters: int = MIN_LETTERS,
    min_articles: int = MIN_ARTICLES,
) -> DataFrame:
    """(id, line_no, block, support): each occurrence of a line that stands in at least min_articles different
    ids of its source; block names the connected component of consecutive repeated lines, support the number of ids.

    Rows with a null id, source or body have no lines; an empty body has none that is long enough; a row delivered
    twice counts once; other columns are ignored. Lengths of bodies and numbers of occurrences have no limit.
    """
    keep = StageTables(articles.sparkSession, "lines")
    lines = _eligible(articles, id_col, source_col, body_col, min_letters)
    # Rows per node first: that is one narrow pre-aggregated shuffle, and lines below the bound end here.
    often = keep.write(lines.groupBy("k1", "k2").agg(F.count("*").alias("n")).where(F.col("n") >= min_articles), "often")
    # one line may be a large part of all
    occ = spread_join(lines, often.drop("n"), ["k1", "k2"], "id", counts=often).dropDuplicates(["id", "line_no", "k1", "k2"])
    occ = keep.write(occ, "occurrences")
    nodes = occ.groupBy("k1", "k2").agg(F.countDistinct("id").alias("support")).where(F.col("support") >= min_articles)
    nodes = keep.write(nodes, "nodes")
    occ = occ.join(nodes, ["k1", "k2"])
    # consecutive: the window's groups are the repeated lines of one article
    w = Window.partitionBy("id").orderBy("line_no")
    name = F.concat_ws(":", F.hex("k1"), F.hex("k2"))
    nxt = occ.withColumns(
        {"a": name, "b": F.lead(name).over(w), "near": F.lead("place").over(w) == F.col("place") + 1}
    ).where("near and b is not null and a <> b")
    edges = nxt.groupBy("a", "b").agg(F.countDistinct("id").alias("w")).where(F.col("w") >= min_articles)
    blocks = connected_components(edges.select("a", "b"), "a", "b")
    nodes = nodes.withColumn("vertex", name).join(blocks, "vertex", "left")
    nodes = nodes.select("k1", "k2", F.coalesce("component", "vertex").alias("block"))
    return occ.join(nodes, ["k1", "k2"]).select("id", "line_no", "block", "support")


def without_lines(articles: DataFrame, found: DataFrame, id_col: str = "article_id", body_col: str = "body") -> DataFrame:
    """The articles with the found (id, line_no) taken out of the body; a row without any is left as it is."""
    out = T.StructField("removed", T.ArrayType(T.IntegerType()))
    gone = found.groupBy(F.col("id").alias("__id")).agg(F.collect_set("line_no").alias(out.name))
    j = articles.join(gone, articles[id_col] == gone["__id"], "left")
    kept = F.array_join(
        F.transform(
            F.filter(
                F.transform(F.split(F.col(body_col), "\n", -1), lambda x, i: F.struct(i.cast("int").alias("i"), x.alias("x"))),
                lambda s: ~F.array_contains(F.col(out.name), s["i"]),
            ),
            lambda s: s["x"],
        ),
        "\n",
    )
    return j.withColumn(body_col, F.when(F.col(out.name).isNull(), F.col(body_col)).otherwise(kept)).drop("__id", out.name)


def _articles(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/articles.parquet").select("article_id", "source", "body")


def p5_found(spark, sf_dir):
    return repeated_lines(_articles(spark, sf_dir)).select(F.col("id").alias("article_id"), "line_no").distinct()


def p5_removed_per_source(spark, sf_dir):
    """Lines and articles touched for each source."""
    a = _articles(spark, sf_dir).where("source is not null and article_id is not null").select("article_id", "source").distinct()
    f = p5_found(spark, sf_dir).groupBy("article_id").agg(F.count("*").alias("n"))
    return a.join(f, "article_id").groupBy("source").agg(F.sum("n").alias("lines"), F.count("*").alias("articles_touched"))


QUERIES = {"p5_found": p5_found, "p5_removed_per_source": p5_removed_per_source}

_P5 = r"""
WITH a AS (SELECT DISTINCT article_id, source, body FROM articles WHERE source IS NOT NULL AND body IS NOT NULL AND article_id IS NOT NULL),
l AS (SELECT article_id, source, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) - 1 AS line_no FROM a),
e AS (SELECT article_id, source, line_no,
        trim(regexp_replace(regexp_replace(lower(line), '\p{Nd}+', '0', 'g'), '[ \t]+', ' ', 'g'), ' ') AS norm
      FROM l WHERE length(regexp_replace(line, '\P{L}+', '', 'g')) >= 20),
k AS (SELECT source, norm FROM e GROUP BY 1, 2 HAVING count(DISTINCT article_id) >= 5),
f AS (SELECT DISTINCT article_id, source, CAST(line_no AS INTEGER) AS line_no FROM e JOIN k USING (source, norm))
"""
SQL = {
    "p5_found": _P5 + "SELECT DISTINCT article_id, line_no FROM f",
    "p5_removed_per_source": _P5 + "SELECT source, CAST(count(*) AS BIGINT) AS lines, count(DISTINCT article_id) AS articles_touched FROM f GROUP BY 1",
}
