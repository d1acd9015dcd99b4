"""Node and edge types: a registry, and checks of data against it.

The registry is open: unknown fields and predicates are always valid, and checks are calls of their own.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadspark.functions.terms import OWL, RDF_TYPE, RDFS, XSD, Value

#: Field kinds and the term kinds they accept.
KINDS = {"text": ("S", "L"), "int": ("I",), "float": ("D", "I"), "bool": ("B",), "node": ("U",), "blob": ("X",), "vector": ("V",), "typed": ("T",)}
VIOLATION = "subject string, predicate string, rule string, detail string"


@dataclass(frozen=True)
class Field:
    kind: str
    required: bool = False


@dataclass
class NodeType:
    name: str
    fields: dict[str, Field] = field(default_factory=dict)
    parents: tuple[str, ...] = ()


@dataclass
class EdgeType:
    predicate: str
    domain: str | None = None
    range: str | None = None
    cardinality: str = "many_to_many"  # one_to_one | one_to_many | many_to_one
    inverse: str | None = None
    fields: dict[str, Field] = field(default_factory=dict)


class Registry:
    def __init__(self):
        self.nodes: dict[str, NodeType] = {}
        self.edges: dict[str, EdgeType] = {}

    def register_node(self, t: NodeType) -> None:
        if t.name in self._above(t.parents, {**self.nodes, t.name: t}):
            raise ValueError(f"{t.name} would be its own ancestor")
        self.nodes[t.name] = t

    def register_edge(self, t: EdgeType) -> None:
        self.edges[t.predicate] = t

    def _above(self, parents, nodes) -> set[str]:
        seen, work = set(), list(parents)
        while work:
            if (name := work.pop()) not in seen:
                seen.add(name)
                work += nodes[name].parents if name in nodes else ()
        return seen

    def fields(self, name: str) -> dict[str, Field]:
        """Own fields before those of parents, the first parent before the next."""
        t = self.nodes[name]
        out: dict[str, Field] = {}
        for parent in reversed(t.parents):
            out |= self.fields(parent) if parent in self.nodes else {}
        return out | t.fields

    def subtypes(self, name: str) -> list[str]:
        return sorted([n for n, t in self.nodes.items() if n == name or name in self._above(t.parents, self.nodes)])

    def predicates_between(self, a: str, b: str) -> list[str]:
        """Edge types whose ends allow the two types; an end that is not set allows any."""
        fits = lambda end, t: end is None or t in self.subtypes(end)
        return sorted(p for p, e in self.edges.items() if fits(e.domain, a) and fits(e.range, b))

    # --- checks: frames of violations -----------------------------------------------------------

    def validate_nodes(self, quads: DataFrame) -> DataFrame:
        """Typed nodes that lack a required field or hold a value of another kind."""
        parts = []
        typed = quads.where(F.col("p") == RDF_TYPE).select("s", F.col("o.str").alias("type"))
        for name in self.nodes:
            own = typed.where(F.col("type") == name).select("s").distinct()
            fields = self.fields(name)
            values = quads.where(F.col("p").isin(*fields)).select("s", "p", "o") if fields else None
            for p, f in fields.items():
                have = values.where(F.col("p") == p)
                if f.required:
                    lacking = own.join(have, "s", "left_anti")
                    parts.append(lacking.select(F.col("s").alias("subject"), F.lit(p).alias("predicate"), F.lit("required").alias("rule"), F.lit(name).alias("detail")))
                wrong = have.where(~F.col("o.kind").isin(*KINDS[f.kind])).join(own, "s", "left_semi")
                parts.append(wrong.select(F.col("s").alias("subject"), F.lit(p).alias("predicate"), F.lit("kind").alias("rule"), F.col("o.kind").alias("detail")))
        return _all(parts, quads)

    def validate_edges(self, quads: DataFrame, annotations: DataFrame | None = None) -> DataFrame:
        """Relations whose ends are not of the declared types or lack a required annotation."""
        parts = []
        typed = quads.where(F.col("p") == RDF_TYPE).select(F.col("s").alias("n"), F.col("o.str").alias("type"))
        for p, e in self.edges.items():
            own = quads.where((F.col("p") == p) & (F.col("o.kind") == "U"))
            for rule, end, column in (("domain", e.domain, F.col("s")), ("range", e.range, F.col("o.str"))):
                if end is not None:
                    good = typed.where(F.col("type").isin(*self.subtypes(end))).select("n").distinct() if self.subtypes(end) else typed.where(F.col("type") == end).select("n").distinct()
                    bad = own.withColumn("n", column).join(good, "n", "left_anti")
                    parts.append(bad.select(F.col("s").alias("subject"), F.lit(p).alias("predicate"), F.lit(rule).alias("rule"), F.col("n").alias("detail")))
            for name, f in e.fields.items():
                if f.required and annotations is not None:
                    have = annotations.where(F.col("p") == name).select("edge_id").distinct()
                    parts.append(own.join(have, "edge_id", "left_anti").select(F.col("s").alias("subject"), F.lit(p).alias("predicate"), F.lit("edge-field").alias("rule"), F.lit(name).alias("detail")))
        return _all(parts, quads)

    def validate_cardinality(self, quads: DataFrame) -> DataFrame:
        """one_to_many allows a subject one object, many_to_one an object one subject, one_to_one both."""
        parts = []
        for p, e in self.edges.items():
            own = quads.where(F.col("p") == p).select("s", F.col("o.key").alias("k"), F.col("o.str").alias("n")).distinct()
            if e.cardinality in ("one_to_many", "one_to_one"):
                many = own.groupBy("s").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
                parts.append(many.select(F.col("s").alias("subject"), F.lit(p).alias("predicate"), F.lit("one-object").alias("rule"), F.col("c").cast("string").alias("detail")))
            if e.cardinality in ("many_to_one", "one_to_one"):
                many = own.groupBy("k").agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("n")).where("c > 1")
                parts.append(many.select(F.col("n").alias("subject"), F.lit(p).alias("predicate"), F.lit("one-subject").alias("rule"), F.col("c").cast("string").alias("detail")))
        return _all(parts, quads)

    def validate_inverses(self, quads: DataFrame) -> DataFrame:
        """Relations whose declared inverse is not there."""
        parts = []
        for p, e in self.edges.items():
            if e.inverse:
                there = quads.where(F.col("p") == e.inverse).select(F.col("o.str").alias("a"), F.col("s").alias("b"))
                own = quads.where((F.col("p") == p) & (F.col("o.kind") == "U")).select(F.col("s").alias("a"), F.col("o.str").alias("b"))
                parts.append(own.join(there, ["a", "b"], "left_anti").select(F.col("a").alias("subject"), F.lit(p).alias("predicate"), F.lit("inverse").alias("rule"), F.col("b").alias("detail")))
        return _all(parts, quads)

    def cycles(self) -> list[str]:
        return sorted(n for n, t in self.nodes.items() if n in self._above(t.parents, self.nodes))

    def validate(self, quads: DataFrame, annotations: DataFrame | None = None) -> DataFrame:
        parts = [self.validate_nodes(quads), self.validate_edges(quads, annotations), self.validate_cardinality(quads), self.validate_inverses(quads)]
        parts.append(quads.sparkSession.createDataFrame([(n, RDFS + "subClassOf", "cycle", n) for n in self.cycles()], VIOLATION))
        return reduce(DataFrame.unionByName, parts)

    # --- as RDF ----------------------------------------------------------------------------------

    def triples(self) -> list[tuple[str, str, str, Value]]:
        """Classes, properties with domain and range, sub-classes and inverses, in the default graph."""
        out: list[tuple] = []
        u = lambda x: Value("U", x)
        types = {"text": "string", "int": "integer", "float": "double", "bool": "boolean"}
        for n, t in self.nodes.items():
            out.append(("", n, RDF_TYPE, u(OWL + "Class")))
            out += [("", n, RDFS + "subClassOf", u(p)) for p in t.parents]
            for f, d in t.fields.items():
                out += [("", f, RDF_TYPE, u(OWL + ("ObjectProperty" if d.kind == "node" else "DatatypeProperty"))), ("", f, RDFS + "domain", u(n))]
                out += [("", f, RDFS + "range", u(XSD + types[d.kind]))] if d.kind in types else []
        for p, e in self.edges.items():
            out.append(("", p, RDF_TYPE, u(OWL + "ObjectProperty")))
            out += [("", p, RDFS + k, u(v)) for k, v in (("domain", e.domain), ("range", e.range)) if v]
            out += [("", p, OWL + "inverseOf", u(e.inverse))] if e.inverse else []
        return out

    @staticmethod
    def from_triples(rows: list[tuple[str, str, str, Value]]) -> Registry:
        by: dict[str, dict[str, list]] = {}
        for _, s, p, o in rows:
            by.setdefault(s, {}).setdefault(p, []).append(o.value)
        out = Registry()
        kinds = {XSD + "string": "text", XSD + "integer": "int", XSD + "double": "float", XSD + "decimal": "float", XSD + "boolean": "bool"}
        for s, ps in sorted(by.items()):
            if OWL + "Class" in ps.get(RDF_TYPE, ()) or RDFS + "Class" in ps.get(RDF_TYPE, ()):
                out.nodes[s] = NodeType(s, {}, tuple(ps.get(RDFS + "subClassOf", ())))
        for s, ps in sorted(by.items()):
            first = lambda k: next(iter(ps.get(k, ())), None)  # noqa: B023, E731
            if OWL + "ObjectProperty" in ps.get(RDF_TYPE, ()):
                out.edges[s] = EdgeType(s, first(RDFS + "domain"), first(RDFS + "range"), inverse=first(OWL + "inverseOf"))
            if OWL + "DatatypeProperty" in ps.get(RDF_TYPE, ()):
                for domain in ps.get(RDFS + "domain", ()):
                    if domain in out.nodes:
                        out.nodes[domain].fields[s] = Field(kinds.get(first(RDFS + "range"), "typed"))
        return out


def _all(parts: list[DataFrame], quads: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts) if parts else quads.sparkSession.createDataFrame([], VIOLATION)


def schema_allows(registry: Registry, snapshot, predicate: str, node: str, end: str = "domain") -> DataFrame | None:
    """``(__typed)``: the node, if it is of a type that the predicate's end accepts; None if any is."""
    e = registry.edges.get(predicate)
    want = getattr(e, end) if e else None
    if want is None:
        return None
    types = snapshot.scan(s=Value("U", node), p=Value("U", RDF_TYPE))
    return types.where(F.col("o.str").isin(*(registry.subtypes(want) or [want]))).select(F.col("s").alias("__typed")).distinct()
