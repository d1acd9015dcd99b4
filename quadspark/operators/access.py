"""Named graphs and who may do what in them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadspark.operators.snapshot import END, INFERRED

#: Levels in their order; a higher one includes the lower ones.
LEVELS = {"read": 1, "propose": 2, "write": 3, "admin": 4}
GRANTS = "who string, graph string, level string"


def levels(grants: DataFrame, members: DataFrame, user: str) -> DataFrame:
    """``(graph, level)`` of a user: the highest of own grants and those of the user's groups.

    ``members (user, grp)``. The default graph is open up to write; a graph's inferred companion has the
    level of the graph.
    """
    spark = grants.sparkSession
    groups = members.where(F.col("user") == user).select(F.col("grp").alias("who")).unionByName(spark.createDataFrame([(user,)], "who string")).distinct()
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv]), F.col("level"))
    own = grants.join(groups, "who", "left_semi").select("graph", rank.alias("level"))
    own = own.unionByName(spark.createDataFrame([("", LEVELS["write"])], "graph string, level int"))
    best = own.groupBy("graph").agg(F.max("level").alias("level"))
    companion = best.select(F.concat(F.lit(INFERRED), "graph").alias("graph"), "level")
    return best.unionByName(companion)


def readable(grants: DataFrame, members: DataFrame, user: str, at_least: str = "read") -> DataFrame:
    return levels(grants, members, user).where(F.col("level") >= LEVELS[at_least]).select("graph")


def visible_quads(quads: DataFrame, grants: DataFrame, members: DataFrame, user: str) -> DataFrame:
    """Quads of graphs that the user may read; a semi-join, as the number of graphs is not bounded."""
    may = readable(grants, members, user).select(F.col("graph").alias("g"))
    return quads.join(may, "g", "left_semi")


def visible_rows(rows: DataFrame, names: list[str], nodes: DataFrame) -> DataFrame:
    """Rows all of whose nodes are among ``nodes (n)``; unbound and literal bindings do not count."""
    for name in names:
        t = F.col(f"`{name}`")
        allowed = nodes.select(F.concat(F.lit("U:"), F.col("n")).alias("__k"))
        hidden = rows.where(t["kind"] == "U").join(allowed, t["key"] == F.col("__k"), "left_semi")
        rows = hidden.unionByName(rows.where(F.coalesce(t["kind"] != "U", F.lit(True))))
    return rows


def grant(grants: DataFrame, who: str, graph: str, level: str) -> DataFrame:
    if level not in LEVELS:
        raise ValueError(f"unknown level {level!r}")
    return grants.unionByName(grants.sparkSession.createDataFrame([(who, graph, level)], GRANTS))


def revoke(grants: DataFrame, who: str, graph: str) -> DataFrame:
    return grants.where(~((F.col("who") == who) & (F.col("graph") == graph)))


# --- graphs -----------------------------------------------------------------------------------

def list_graphs(quads: DataFrame) -> DataFrame:
    return quads.select("g").distinct()


def stats(live: DataFrame) -> DataFrame:
    """``(g, quads, last_tt)`` of each graph."""
    return live.groupBy("g").agg(F.count(F.lit(1)).alias("quads"), F.max("tt").alias("last_tt"))


def closing(live: DataFrame, at: int, tt: int) -> DataFrame:
    """Versions that end live quads at ``at``: same start, written at ``tt``."""
    return live.select("g", "s", "p", "o", "edge_id", "vt_start", F.greatest(F.lit(at), F.col("vt_start")).alias("vt_end"), F.lit(tt).alias("tt"))


def drop_graph(live: DataFrame, graph: str, at: int, tt: int) -> DataFrame:
    return closing(live.where(F.col("g") == graph), at, tt)


def copy_graph(live: DataFrame, source: str, target: str, at: int, tt: int, clear: bool = False) -> DataFrame:
    """Versions that copy a graph's live quads, keeping valid time; ``clear`` closes the target's first."""
    copied = live.where(F.col("g") == source).withColumn("g", F.lit(target)).withColumn("tt", F.lit(tt))
    cols = ["g", "s", "p", "o", "edge_id", "vt_start", "vt_end", "tt"]
    copied = copied.select(*cols)
    if not clear:
        return copied
    keys = copied.select("s", "p", F.col("o.key").alias("k"))
    rest = live.where(F.col("g") == target).withColumn("k", F.col("o.key")).join(keys, ["s", "p", "k"], "left_anti").drop("k")
    return copied.unionByName(closing(rest, at, tt))


def move_graph(live: DataFrame, source: str, target: str, at: int, tt: int) -> DataFrame:
    return copy_graph(live, source, target, at, tt, True).unionByName(drop_graph(live, source, at, tt))


def counters(deltas: DataFrame) -> DataFrame:
    """``(namespace, node, value)``: sums of deltas, held within 64 bits."""
    total = F.sum(F.col("delta").cast("decimal(38,0)"))
    held = F.greatest(F.lit(-(1 << 63)).cast("decimal(38,0)"), F.least(F.lit(END).cast("decimal(38,0)"), total))
    return deltas.groupBy("namespace", "node").agg(held.cast("bigint").alias("value"))
