"""Problem 6: one group id for every record linked directly or indirectly.

Method: a two-dimensional grid. Vertices are hashed into blocks; an edge lies in the cell (block of one end,
block of the other). Every cell runs a local union-find and replaces its edges by a spanning star from each
vertex to the cell's representative. A vertex then takes the best representative of all cells in its row and
column, edges are rewritten to these parents, and the rounds go on until no edge is left. Representatives are
chosen by a hash that changes with the round, so the vertices left shrink by a constant factor in expectation
for every shape of graph, chains and stars included; nothing depends on how the ids are ordered.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators.blocks import spread_join
from threadloom.session import StageTables

#: Edges that one cell's union-find gets at most, save for a few in a hash collision. It bounds a task's memory.
EDGES_PER_CELL = 200_000


def _local_union_find(u: np.ndarray, v: np.ndarray, pu: np.ndarray, pv: np.ndarray) -> pd.DataFrame:
    """Stars of the components of the edges u-v; the centre is the vertex of least (priority, id)."""
    codes, names = pd.factorize(np.concatenate([u, v]))
    prio = np.empty(len(names), dtype=np.int64)
    prio[codes] = np.concatenate([pu, pv])
    rank = np.empty(len(names), dtype=np.int64)
    rank[np.lexsort((names.astype(str), prio))] = np.arange(len(names))
    parent = list(range(len(names)))
    key = rank.tolist()
    n = len(u)
    for a, b in zip(codes[:n].tolist(), codes[n:].tolist()):
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        while parent[b] != b:
            parent[b] = b = parent[parent[b]]
        if a != b:
            if key[a] < key[b]:
                parent[b] = a
            else:
                parent[a] = b
    root = np.array(parent)
    while True:
        up = root[root]
        if (up == root).all():
            break
        root = up
    return pd.DataFrame({"vertex": names, "rep": names[root], "prio": prio[root]})


def _solve_cells(batches):
    """Rows come sorted by cell; a cell is solved once its last row is there."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        cells = pdf["cell"].to_numpy()
        cuts = np.flatnonzero(cells[1:] != cells[:-1]) + 1
        start = 0
        for end in [*cuts.tolist(), len(pdf)]:
            if held and held[0]["cell"].iat[0] != cells[start]:
                yield _solved(held)
                held = []
            if end > start:
                held.append(pdf.iloc[start:end])
            start = end
    if held:
        yield _solved(held)


def _solved(parts: list[pd.DataFrame]) -> pd.DataFrame:
    p = pd.concat(parts)
    return _local_union_find(p["u"].to_numpy(object), p["v"].to_numpy(object), p["pu"].to_numpy(), p["pv"].to_numpy())


def _grid_stars(edges: DataFrame, n_edges: int, seed: int, edges_per_cell: int) -> DataFrame:
    side = max(1, math.ceil(math.sqrt(n_edges / edges_per_cell)))
    block = lambda c: F.pmod(F.xxhash64(F.lit(seed + 7), F.col(c)), F.lit(side))
    e = edges.withColumns({"pu": F.xxhash64(F.lit(seed), F.col("u")), "pv": F.xxhash64(F.lit(seed), F.col("v"))})
    if side == 1:
        e = e.withColumn("cell", F.lit(0).cast("long")).coalesce(1)
        return e.select("cell", "u", "v", "pu", "pv").mapInPandas(_solve_cells, "vertex string, rep string, prio long")
    row, col = F.least(block("u"), block("v")), F.greatest(block("u"), block("v"))
    e = e.withColumn("cell", row * side + col)
    # A vertex with very many edges overfills the cells of its row: such cells are cut once more by the hash of the edge.
    parts = e.groupBy("cell").agg(F.ceil(F.count("*") / edges_per_cell).cast("long").alias("cuts"))
    hot = parts.where("cuts > 1")
    e = e.join(hot, "cell", "left").withColumn(
        "cell",
        F.col("cell") * 1_000_003
        + F.when(F.col("cuts") > 1, F.pmod(F.xxhash64(F.lit(seed + 11), "u", "v"), F.col("cuts"))).otherwise(0),
    )
    n = max(2, math.ceil(2 * n_edges / edges_per_cell))
    return (
        e.select("cell", "u", "v", "pu", "pv")
        .repartition(n, "cell")
        .sortWithinPartitions("cell")
        .mapInPandas(_solve_cells, "vertex string, rep string, prio long")
    )


def connected_components(
    edges: DataFrame, left: str = "left_id", right: str = "right_id", edges_per_cell: int = EDGES_PER_CELL
) -> DataFrame:
    """(vertex string, component string): every vertex of an edge between two different ids, with the least id
    (string order) of its component.

    Rows with a null id and edges of an id with itself link nothing; repeated and reversed edges count once; an
    empty table gives an empty result. Other columns are ignored, whatever their names. The size of a component,
    the degree of a vertex and the length of a chain have no limit.
    """
    spark = edges.sparkSession
    keep = StageTables(spark, "components")
    l, r = edges[left].cast("string"), edges[right].cast("string")
    e = edges.select(F.least(l, r).alias("u"), F.greatest(l, r).alias("v"), (l.isNotNull() & r.isNotNull() & (l != r)).alias("ok"))
    e = keep.write(e.where("ok").select("u", "v").distinct(), "edges0")
    maps: list[DataFrame] = []
    n, k = e.count(), 0
    while n:
        stars = keep.write(_grid_stars(e, n, 1000 * k + 13, edges_per_cell), f"stars{k}")
        best = stars.groupBy("vertex").agg(F.min(F.struct("prio", "rep")).alias("b"))
        parents = keep.write(best.select("vertex", F.col("b.rep").alias("parent")), f"parents{k}")
        maps.append(parents)
        if n > edges_per_cell:
            s = stars.where("vertex <> rep").select("vertex", "rep")
            s = s.join(parents.withColumnRenamed("parent", "pv"), "vertex")
            # one representative may stand for very many vertices
            s = spread_join(s, parents.select(F.col("vertex").alias("rep"), F.col("parent").alias("pr")), ["rep"], "vertex")
            s = s.where("pv <> pr").select(F.least("pv", "pr").alias("u"), F.greatest("pv", "pr").alias("v"))
            e = keep.write(s.distinct(), f"edges{k + 1}")
            n = e.count()
        else:  # one cell held all edges, so its stars are the components
            n = 0
        keep.drop(f"stars{k}")
        keep.drop(f"edges{k}")
        k += 1
    if not maps:
        return spark.createDataFrame([], "vertex string, component string")
    label = maps[-1].select("vertex", F.col("parent").alias("label"))
    for m in reversed(maps[:-1]):
        up = label.select(F.col("vertex").alias("parent"), F.col("label").alias("further"))
        label = spread_join(m, up, ["parent"], "vertex", how="left").select("vertex", F.coalesce("further", "parent").alias("label"))
    least = label.groupBy("label").agg(F.min("vertex").alias("component"), F.count("*").alias("n"))
    return spread_join(label, least.drop("n"), ["label"], "vertex", counts=least).select("vertex", "component")


def groups_of_pairs(pairs: DataFrame, edges_per_cell: int = EDGES_PER_CELL) -> DataFrame:
    """(profile_id, group_id) of scored pairs: ids that any row with decision 'match' links to another id.

    A later 'no_match' of the same two ids does not undo the link; null decisions and ids link nothing.
    """
    cc = connected_components(pairs.where(F.col("decision") == "match"), "left_id", "right_id", edges_per_cell)
    return cc.select(F.col("vertex").alias("profile_id"), F.col("component").alias("group_id"))


def p6_found(spark, sf_dir):
    return groups_of_pairs(spark.read.parquet(f"{sf_dir}/scored_pairs.parquet"))


def p6_group_sizes(spark, sf_dir):
    """How many groups there are of each size."""
    g = p6_found(spark, sf_dir).groupBy("group_id").agg(F.count("*").alias("members"))
    return g.groupBy("members").agg(F.count("*").alias("n_groups"))


QUERIES = {"p6_found": p6_found, "p6_group_sizes": p6_group_sizes}

_P6 = """
WITH RECURSIVE e AS (
  SELECT left_id AS a, right_id AS b FROM scored_pairs WHERE decision = 'match' AND left_id <> right_id
  UNION SELECT right_id, left_id FROM scored_pairs WHERE decision = 'match' AND left_id <> right_id),
reach(v, r) AS (SELECT a, a FROM e UNION SELECT e.b, reach.r FROM reach JOIN e ON e.a = reach.v),
g AS (SELECT v AS profile_id, min(r) AS group_id FROM reach GROUP BY v)
"""
SQL = {
    "p6_found": _P6 + "SELECT profile_id, group_id FROM g",
    "p6_group_sizes": _P6
    + "SELECT members, count(*) AS n_groups FROM (SELECT group_id, count(*) AS members FROM g GROUP BY 1) s GROUP BY members",
}
