"""Quads as of a moment, and scans over them.

Stored quads are versions: ``g s p o edge_id vt_start vt_end tt``, times in microseconds. A snapshot
keeps what was known by ``tt`` and had begun by ``vt``; of a quad's versions the latest ``vt_start``
counts, then the latest ``tt``, and it is live if it has not ended.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadspark.functions import terms
from quadspark.plans.patterns import ANY, UNION, Graph, Slot, Value

END = (1 << 63) - 1
QUAD_DDL = f"g string, s string, p string, o {terms.TERM_DDL}, edge_id string, vt_start bigint, vt_end bigint, tt bigint"
INFERRED = "urn:q:inferred:"


def edge_id(s: Column, p: Column, key: Column) -> Column:
    """The id of an edge that was not given one: the same on every attempt of a task."""
    return F.concat(F.lit("urn:edge:"), F.substring(F.sha2(F.concat_ws("\0", s, p, key), 256), 1, 32))


def last_versions(versions: DataFrame) -> DataFrame:
    """The last version of each quad: one partial aggregation, a maximum over a struct."""
    last = F.max(F.struct("vt_start", "tt", "vt_end", "edge_id", "o")).alias("last")
    best = versions.withColumn("key", F.col("o.key")).groupBy("g", "s", "p", "key").agg(last)
    return best.select("g", "s", "p", "last.o", "last.edge_id", "last.vt_start", "last.vt_end", "last.tt")


def live_rows(state: DataFrame, at: int = END - 1) -> DataFrame:
    return state.where(F.col("vt_end") > at)


def resolve(versions: DataFrame, vt: int | None = None, tt: int | None = None) -> DataFrame:
    """Live quads at valid time ``vt`` as known at ``tt``; None is the end of time (nothing ended, all known)."""
    at = END - 1 if vt is None else vt
    rows = versions.where(F.col("vt_start") <= at)
    if tt is not None:
        rows = rows.where(F.col("tt") <= tt)
    return live_rows(last_versions(rows), at)


@dataclass(frozen=True)
class Snapshot:
    """A provider of live quads ``(g, s, p, o, edge_id)``.

    ``source`` returns the quads of one predicate, or of all for None, so a bound predicate reads only
    what it needs. ``one_graph`` says that all quads are in one graph, which makes the union of graphs
    free of duplicates; ``single`` that a subject has one value of a property at most, but for the
    predicates of ``many``. ``picked`` is the source of quads that pass a test on graph, subject, predicate
    and object, for sources that can apply it early; ``typed`` that of the quads that give one type;
    ``rows`` that of subjects with several predicates, ``(s, o0, o1, ...)``, where rows of a table hold them
    side by side, or None: such a star takes no join.
    """

    source: Callable[[str | None], DataFrame]
    one_graph: bool = False
    single: bool = False
    many: frozenset[str] = frozenset()
    readable: tuple[str, ...] | None = None
    inferred: bool = True
    annotations: DataFrame | None = None
    picked: Callable[[str | None, Column], DataFrame] | None = None
    typed: Callable[[str], DataFrame] | None = None
    rows: Callable[[list[str], str | None], DataFrame | None] | None = None

    @staticmethod
    def of(quads: DataFrame, annotations: DataFrame | None = None) -> Snapshot:
        return Snapshot(lambda p: quads if p is None else quads.where(F.col("p") == p), annotations=annotations)

    def one_value(self, predicate: str) -> bool:
        return self.single and predicate not in self.many

    def restricted(self, readable: list[str] | None = None, inferred: bool = True) -> Snapshot:
        """The graphs that may be read, and whether inferred ones count; applied before all else."""
        return replace(self, readable=None if readable is None else tuple(readable), inferred=inferred)

    def scan(self, s: Slot = ANY, p: Slot = ANY, o: Slot = ANY, graph: Graph = UNION) -> DataFrame:
        """Quads that match the bound terms, in the graphs of the scope.

        The union shows a triple once, with the least graph that has it; other scopes show each graph.
        """
        tests = []
        if self.readable is not None:
            tests.append(F.col("g").isin(*self.readable) if self.readable else F.lit(False))
        if not self.inferred:
            tests.append(~F.col("g").startswith(INFERRED))
        if graph.kind in ("one", "set", "set-named"):
            tests.append(F.col("g").isin(*graph.iris) if graph.iris else F.lit(False))
        elif graph.kind == "named":
            tests.append(F.col("g") != "")
        if isinstance(s, Value):
            tests.append(F.col("s") == s.value if s.kind == "U" else F.lit(False))
        if isinstance(p, Value):
            tests.append(F.col("p") == p.value)
        if isinstance(o, Value):
            tests.append(F.col("o.key") == o.key())
        name = p.value if isinstance(p, Value) and p.kind == "U" else None
        if tests and self.picked:
            rows = self.picked(name, reduce(lambda a, b: a & b, tests))
        else:
            given = self.typed is not None and name == terms.RDF_TYPE and isinstance(o, Value) and o.kind == "U"
            rows = reduce(DataFrame.where, tests, self.typed(o.value) if given else self.source(name))
        merged = graph.kind == "union" or (graph.kind == "set" and len(graph.iris) > 1)
        if merged and not self.one_graph:
            first = F.min(F.struct("g", "edge_id", "o")).alias("x")
            rows = rows.withColumn("key", F.col("o.key")).groupBy("s", "p", "key").agg(first).select("x.g", "s", "p", "x.o", "x.edge_id")
        return rows

    def graphs_of(self, subject: str) -> DataFrame:
        return self.scan(s=Value("U", subject), graph=Graph("all")).select("s", "g").distinct()


def overlay(stored: DataFrame, pending: DataFrame) -> DataFrame:
    """Own writes over stored quads: a pending property hides the stored ones of its subject and predicate,
    a pending relation hides the same relation."""
    props = pending.where(F.col("o.kind") != "U").select("s", "p").distinct()
    rels = pending.where(F.col("o.kind") == "U").select("s", "p", F.col("o.key").alias("k")).distinct()
    kept = stored.withColumn("k", F.col("o.key"))
    values = kept.where(F.col("o.kind") != "U").join(props, ["s", "p"], "left_anti")
    nodes = kept.where(F.col("o.kind") == "U").join(rels, ["s", "p", "k"], "left_anti")
    return values.unionByName(nodes).drop("k").unionByName(pending.select(*stored.columns))


def edge_ids(versions: DataFrame, s: str, p: str, o: Value) -> DataFrame:
    """``(edge_id, tt)`` of a triple: the newest of each graph, newest first."""
    rows = versions.where((F.col("s") == s) & (F.col("p") == p) & (F.col("o.key") == o.key()))
    newest = rows.groupBy("g").agg(F.max_by("edge_id", "tt").alias("edge_id"), F.max("tt").alias("tt"))
    return newest.groupBy("edge_id").agg(F.max("tt").alias("tt")).orderBy(F.desc("tt"), "edge_id")


def history(versions: DataFrame, s: str | None = None, p: str | None = None, limit: int | None = 50) -> DataFrame:
    """Property versions, newest first. A closed version written with an open one is a replacement's
    closing entry and is left out. ``limit`` is the report's length; None is all."""
    rows = versions.where(F.col("o.kind") != "U")
    rows = rows if s is None else rows.where(F.col("s") == s)
    rows = rows if p is None else rows.where(F.col("p") == p)
    opened = F.max((F.col("vt_end") == END).cast("int")).over(Window.partitionBy("s", "p", "tt"))
    shown = rows.withColumn("__open", opened).where((F.col("__open") == 0) | (F.col("vt_end") == END)).drop("__open")
    ordered = shown.orderBy(F.desc("tt"), "s", "p", "o.key")
    return ordered if limit is None else ordered.limit(limit)


def retain(versions: DataFrame, tx_cutoff: int | None = None, vt_cutoff: int | None = None) -> DataFrame:
    """Versions that retention leaves.

    Before ``tx_cutoff``, a version goes if a newer one of the same quad and start was written by then;
    a quad whose remaining versions all ended before ``vt_cutoff`` goes as a whole.
    """
    quad = ["g", "s", "p", "__k"]
    rows = versions.withColumn("__k", F.col("o.key"))
    if tx_cutoff is not None:
        newest = F.max(F.when(F.col("tt") < tx_cutoff, F.col("tt"))).over(Window.partitionBy(*quad, "vt_start"))
        rows = rows.withColumn("__n", newest).where(F.col("__n").isNull() | (F.col("tt") >= F.col("__n"))).drop("__n")
    if vt_cutoff is not None:
        rows = rows.withColumn("__e", F.max("vt_end").over(Window.partitionBy(*quad))).where(F.col("__e") >= vt_cutoff).drop("__e")
    return rows.drop("__k")


#: Longest literal that text search looks at, in bytes.
TEXT_BYTES = 512


def texts(quads: DataFrame, predicate: str | None = None, max_bytes: int = TEXT_BYTES) -> DataFrame:
    rows = quads.where(F.col("o.kind").isin("S", "L") & (F.octet_length("o.str") <= max_bytes))
    return rows if predicate is None else rows.where(F.col("p") == predicate)


def text_search(quads: DataFrame, query: str, predicate: str | None = None, max_bytes: int = TEXT_BYTES) -> DataFrame:
    """Literals of at most ``max_bytes`` bytes that contain the query, in whatever case."""
    return texts(quads, predicate, max_bytes).where(F.contains(F.lower("o.str"), F.lit(query.lower())))


def trigrams(quads: DataFrame) -> DataFrame:
    """``(gram, g, s, p, key)``: the different runs of three characters of each short literal, in lower case."""
    low = F.lower("o.str")
    starts = F.when(F.length(low) >= 3, F.sequence(F.lit(1), F.length(low) - 2)).otherwise(F.array().cast("array<int>"))
    grams = F.array_distinct(F.transform(starts, lambda at: F.substring(low, at, 3)))
    return texts(quads).select(F.explode(grams).alias("gram"), "g", "s", "p", F.col("o.key").alias("key"))


def gram_hits(index: DataFrame, query: str, predicate: str | None = None) -> DataFrame:
    """``(g, s, p, key)`` of literals that have all trigrams of the query (three characters or more)."""
    low = query.lower()
    grams = sorted({low[k : k + 3] for k in range(len(low) - 2)})
    rows = index.where(F.col("gram").isin(*grams))
    rows = rows if predicate is None else rows.where(F.col("p") == predicate)
    return rows.groupBy("g", "s", "p", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(grams)).drop("n")


def latest_annotations(annotations: DataFrame, tt: int | None = None) -> DataFrame:
    """The newest value of each (edge, predicate) known at ``tt``."""
    rows = annotations if tt is None else annotations.where(F.col("tt") <= tt)
    return rows.groupBy("edge_id", "p").agg(F.max_by("o", F.struct("tt", F.col("o.key"))).alias("o"), F.max("tt").alias("tt"))


def scan_annotations(annotations: DataFrame, edge: str | None = None, p: str | None = None) -> DataFrame:
    """Annotations by edge, by edge and predicate, or by predicate; a full scan is empty by contract."""
    if edge is None and p is None:
        return annotations.where(F.lit(False))
    rows = annotations if edge is None else annotations.where(F.col("edge_id") == edge)
    return rows if p is None else rows.where(F.col("p") == p)


def view(quads: DataFrame, labels: dict[str, tuple[str, bool]], nodes: DataFrame | None = None) -> DataFrame:
    """A projection: predicates of the view only, shown under their labels; relations may show reversed.

    ``labels`` is predicate -> (label, reversed); ``nodes (s)`` limits the subjects.
    """
    rows = quads.where(F.col("p").isin(*labels)) if labels else quads.where(F.lit(False))
    rows = rows if nodes is None else rows.join(nodes.select("s").distinct(), "s", "left_semi")
    label = F.create_map(*[F.lit(x) for p, (name, _) in labels.items() for x in (p, name)]) if labels else F.lit(None)
    back = [p for p, (_, reverse) in labels.items() if reverse]
    flip = F.col("p").isin(*back) & (F.col("o.kind") == "U") if back else F.lit(False)
    return rows.select("g", F.when(flip, F.col("o.str")).otherwise(F.col("s")).alias("s"), label[F.col("p")].alias("label"), F.when(flip, terms.node(F.col("s"))).otherwise(F.col("o")).alias("o"), flip.alias("reversed"))

