"""Relational tables as quads, without building them.

A row is the node ``urn:d:<table>:<key>`` of type ``urn:d:<Table>``; a foreign key is a relation,
any other column a property, both named as the column. Each predicate's quads are a projection of its
source column, so a pattern with a bound predicate reads one column, and a filter on it reaches the scan.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadspark.functions import terms
from quadspark.functions.terms import RDF_TYPE, XSD
from quadspark.operators.snapshot import Snapshot

BASE = "urn:d:"


@dataclass(frozen=True)
class Table:
    """How a table maps: key columns, foreign keys (column -> table), columns left out."""

    name: str
    keys: tuple[str, ...]
    links: tuple[tuple[str, str], ...] = ()
    skip: tuple[str, ...] = ()
    graph: str | None = None  # a column that names the graph

    @property
    def type(self) -> str:
        return BASE + self.name.capitalize()


TABLES = (
    Table("region", ("r_regionkey",)),
    Table("nation", ("n_nationkey",), (("n_regionkey", "region"),)),
    Table("customer", ("c_custkey",), (("c_nationkey", "nation"),)),
    Table("supplier", ("s_suppkey",), (("s_nationkey", "nation"),)),
    Table("part", ("p_partkey",)),
    Table("orders", ("o_orderkey",), (("o_custkey", "customer"),)),
    Table("lineitem", ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), (("l_orderkey", "orders"), ("l_partkey", "part"), ("l_suppkey", "supplier"))),
    Table("documents", ("doc_id",)),
    Table("labels", ("doc_id",)),
    Table("pages", ("page_id",)),
    Table("conversations", ("conv_id", "turn")),
)


def iri(table: str, *keys: Column) -> Column:
    return F.concat(F.lit(f"{BASE}{table}:"), F.concat_ws("-", *[k.cast("string") for k in keys]))


class TableStore:
    """Quads of the tables in a folder, all in the default graph."""

    def __init__(self, spark: SparkSession, folder: str, tables: tuple[Table, ...] = TABLES):
        self.spark, self.folder = spark, folder
        self.tables = tables
        self.frames: dict[str, DataFrame] = {}

    def frame(self, name: str) -> DataFrame:
        if name not in self.frames:
            self.frames[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self.frames[name]

    def _value(self, df: DataFrame, column: str) -> Column | None:
        kind, c = dict(df.dtypes)[column], F.col(column)
        if kind in ("bigint", "int", "smallint", "tinyint"):
            return terms.integer(c.cast("bigint"))
        if kind in ("double", "float") or kind.startswith("decimal"):
            return terms.double(c)
        if kind.startswith("timestamp"):
            return terms.typed(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(XSD + "dateTime"))
        if kind == "date":
            return terms.typed(c.cast("string"), F.lit(XSD + "date"))
        return {"string": terms.text, "boolean": terms.boolean}[kind](c) if kind in ("string", "boolean") else None

    def _quads(self, t: Table, p: str, o: Column) -> DataFrame:
        rows = self.frame(t.name).select(F.lit("").alias("g"), iri(t.name, *map(F.col, t.keys)).alias("s"), F.lit(p).alias("p"), o.alias("o"))
        return rows.where(F.col("o").isNotNull()).withColumn("edge_id", F.when(F.col("o.kind") == "U", F.concat_ws("|", "s", "p", F.col("o.key"))))

    def predicate(self, name: str, of_type: str | None = None) -> DataFrame:
        """Quads of one predicate, from every table that has it; with ``of_type`` tables of that type only."""
        parts = []
        for t in self.tables:
            if of_type not in (None, t.type):
                continue
            if name == RDF_TYPE:
                parts.append(self._quads(t, name, terms.node(F.lit(t.type))))
                continue
            if not name.startswith(BASE):
                continue
            column, links = name[len(BASE) :], dict(t.links)
            columns = self.frame(t.name).columns if column not in links else ()
            if column in links:
                parts.append(self._quads(t, name, terms.node(F.when(F.col(column).isNotNull(), iri(links[column], F.col(column))))))
            elif column in columns and column not in t.skip and column not in t.keys:
                value = self._value(self.frame(t.name), column)
                parts += [self._quads(t, name, value)] if value is not None else []
        if not parts:
            return self.spark.createDataFrame([], f"g string, s string, p string, o {terms.TERM_DDL}, edge_id string")
        return reduce(DataFrame.unionByName, parts)

    def _object(self, t: Table, name: str) -> Column | None:
        """The term that a row of the table has under a predicate; None if the table does not have it."""
        if name == RDF_TYPE:
            return terms.node(F.lit(t.type))
        column, links = name[len(BASE) :] if name.startswith(BASE) else "", dict(t.links)
        if column in links:
            return terms.node(F.when(F.col(column).isNotNull(), iri(links[column], F.col(column))))
        return self._value(self.frame(t.name), column) if column not in (*t.skip, *t.keys) and column in self.frame(t.name).columns else None

    def rows(self, names: list[str], of_type: str | None = None) -> DataFrame | None:
        """``(s, o0, o1, ...)`` of rows that have all the predicates, from every table that has them; with
        ``of_type`` tables of that type only. None if no table does."""
        parts = []
        for t in self.tables:
            if of_type not in (None, t.type) or not all(n == RDF_TYPE or n.startswith(BASE) for n in names):
                continue
            # names are looked at before a table is opened: most tables have none of them
            if not all(n == RDF_TYPE or n[len(BASE) :] in dict(t.links) or n[len(BASE) :] in self.frame(t.name).columns for n in names):
                continue
            found = [self._object(t, n) for n in names]
            if all(o is not None for o in found):
                rows = self.frame(t.name).select(iri(t.name, *map(F.col, t.keys)).alias("s"), *[o.alias(f"o{k}") for k, o in enumerate(found)])
                parts.append(rows.where(reduce(lambda a, b: a & b, [F.col(f"o{k}").isNotNull() for k in range(len(found))])))
        return reduce(DataFrame.unionByName, parts) if parts else None

    def predicates(self) -> list[str]:
        out = [RDF_TYPE]
        for t in self.tables:
            out += [BASE + c for c in dict(t.links)]
            out += [BASE + c for c in self.frame(t.name).columns if c not in t.keys and c not in dict(t.links) and c not in t.skip and self._value(self.frame(t.name), c) is not None]
        return list(dict.fromkeys(out))

    def snapshot(self, annotations: DataFrame | None = None) -> Snapshot:
        def source(p: str | None) -> DataFrame:
            return self.predicate(p) if p is not None else reduce(DataFrame.unionByName, map(self.predicate, self.predicates()))

        return Snapshot(source, one_graph=True, single=True, annotations=annotations, typed=lambda t: self.predicate(RDF_TYPE, t), rows=self.rows)

    def lineitem_annotations(self) -> DataFrame:
        """Quantity and discount as annotations on the edge from a line to its part."""
        df = self.frame("lineitem")
        s, o = iri("lineitem", *[F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]), F.concat(F.lit("U:"), iri("part", F.col("l_partkey")))
        edge = F.concat_ws("|", s, F.lit(BASE + "l_partkey"), o)
        row = lambda p, c: df.select(edge.alias("edge_id"), F.lit("").alias("g"), F.lit(BASE + p).alias("p"), terms.double(F.col(c)).alias("o"), F.lit(1).cast("bigint").alias("tt"))
        return row("quantity", "l_quantity").unionByName(row("discount", "l_discount"))


def event_versions(events: DataFrame) -> DataFrame:
    """Events as versions: a user's last value of each type, from the event's time until the next one."""
    from quadspark.operators.snapshot import END

    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    o = terms.double(F.col("value"))
    return events.where(F.col("user_id").isNotNull() & F.col("ts").isNotNull() & F.col("value").isNotNull()).select(
        F.lit("").alias("g"), F.concat(F.lit("urn:d:user:"), F.col("user_id").cast("string")).alias("s"), F.concat(F.lit(BASE), F.col("event_type")).alias("p"), o.alias("o"),
        F.lit(None).cast("string").alias("edge_id"), micros.alias("vt_start"), F.lit(END).alias("vt_end"), (micros + F.col("event_id")).alias("tt"),
    )
