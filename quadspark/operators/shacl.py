"""SHACL core validation: shapes from RDF, violations as one DataFrame.

Each shape gives a frame of focus nodes, each property path a frame of (focus, value), and each
constraint a frame of violations; the report is their union. Nested ``sh:node`` shapes compile the same
way, and a shape met again on the way to itself counts as conforming.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadspark.functions import terms
from quadspark.functions.terms import RDF, RDF_TYPE, RDFS, SH, TERM_DDL, Value
from quadspark.operators import recursion
from quadspark.scratch import Scratch

REPORT = f"focus string, path string, value {TERM_DDL}, shape string, component string, severity string, message string"


@dataclass
class Shape:
    iri: str
    targets: list[tuple[str, str]] = field(default_factory=list)  # (class | node | subjectsOf | objectsOf, IRI)
    path: list[tuple[str, bool]] | None = None  # steps of (predicate, inverse); None for a node shape
    constraints: list[tuple[str, object]] = field(default_factory=list)
    properties: list[str] = field(default_factory=list)
    severity: str = SH + "Violation"
    message: str | None = None


_PLAIN = ("minCount", "maxCount", "datatype", "class", "nodeKind", "minInclusive", "maxInclusive", "minExclusive", "maxExclusive", "pattern", "minLength", "maxLength", "node")
_TARGETS = {"targetClass": "class", "targetNode": "node", "targetSubjectsOf": "subjectsOf", "targetObjectsOf": "objectsOf"}


def shapes(rows: list[tuple[str, str, str, Value]]) -> dict[str, Shape]:
    """Shapes of a small list of quads ``(g, s, p, o)``."""
    by: dict[str, dict[str, list[Value]]] = {}
    for _, s, p, o in rows:
        by.setdefault(s, {}).setdefault(p, []).append(o)

    def items(head: str) -> list[Value]:
        out = []
        while head != RDF + "nil":
            out.append(by[head][RDF + "first"][0])
            head = by[head][RDF + "rest"][0].value
        return out

    def path(at: Value) -> list[tuple[str, bool]]:
        own = by.get(at.value, {})
        if RDF + "first" in own:
            return [step for item in items(at.value) for step in path(item)]
        if SH + "inversePath" in own:
            inner = path(own[SH + "inversePath"][0])
            if len(inner) != 1:
                raise ValueError("an inverse path of a predicate only")
            return [(inner[0][0], not inner[0][1])]
        if any(p.startswith(SH) and p.endswith("Path") for p in own):
            raise ValueError("predicate, inverse and sequence paths only")
        return [(at.value, False)]

    out = {}
    for s, ps in by.items():
        kinds = {o.value for o in ps.get(RDF_TYPE, ())}
        used = any(p.startswith(SH) and p[len(SH) :] in (*_PLAIN, *_TARGETS, "property", "in", "closed") for p in ps)
        if not (kinds & {SH + "NodeShape", SH + "PropertyShape"} or used):
            continue
        shape = out[s] = Shape(s)
        for p, values in ps.items():
            name = p[len(SH) :] if p.startswith(SH) else ""
            if name in _TARGETS:
                shape.targets += [(_TARGETS[name], v.value) for v in values]
            elif name == "path":
                shape.path = path(values[0])
            elif name == "property":
                shape.properties += [v.value for v in values]
            elif name == "severity":
                shape.severity = values[0].value
            elif name == "message":
                shape.message = values[0].value
            elif name == "in":
                shape.constraints.append(("in", items(values[0].value)))
            elif name == "closed" and values[0].value:
                ignored = [v.value for v in items(ps[SH + "ignoredProperties"][0].value)] if SH + "ignoredProperties" in ps else []
                shape.constraints.append(("closed", ignored))
            elif name in _PLAIN:
                flags = ps.get(SH + "flags", [Value("S", "")])[0].value if name == "pattern" else None
                shape.constraints += [(name, (v.value, flags) if flags is not None else v) for v in values]
        if RDFS + "Class" in kinds or "http://www.w3.org/2002/07/owl#Class" in kinds:
            shape.targets.append(("class", s))
    return out


class Validator:
    def __init__(self, shape_map: dict[str, Shape], quads: DataFrame):
        self.shapes, self.quads = shape_map, quads
        self.spark = quads.sparkSession
        sub = quads.where((F.col("p") == RDFS + "subClassOf") & (F.col("o.kind") == "U")).select("s", F.col("o.str").alias("o"))
        self._sub, self._closed = sub, None

    def below(self, cls: str) -> DataFrame:
        """Instances ``(n)`` of a class or one below it."""
        if self._closed is None:
            self._closed = recursion.closure(self._sub)
        typed = self.quads.where((F.col("p") == RDF_TYPE) & (F.col("o.kind") == "U")).select(F.col("s").alias("n"), F.col("o.str").alias("c"))
        classes = self._closed.where(F.col("o") == cls).select(F.col("s").alias("c")).unionByName(self.spark.createDataFrame([(cls,)], "c string")).distinct()
        return typed.join(classes, "c", "left_semi").select("n").distinct()

    def focus(self, shape: Shape, limit: DataFrame | None = None) -> DataFrame:
        parts = []
        for kind, iri in shape.targets:
            own = self.quads.where(F.col("p") == iri)
            if kind == "class":
                parts.append(self.below(iri))
            elif kind == "node":
                parts.append(self.spark.createDataFrame([(iri,)], "n string"))
            elif kind == "subjectsOf":
                parts.append(own.select(F.col("s").alias("n")))
            else:
                parts.append(own.where(F.col("o.kind") == "U").select(F.col("o.str").alias("n")))
        out = reduce(DataFrame.unionByName, parts).distinct() if parts else self.spark.createDataFrame([], "n string")
        return out if limit is None else out.join(limit.select(F.col("s").alias("n")).distinct(), "n", "left_semi")

    def values(self, focus: DataFrame, path: list[tuple[str, bool]] | None) -> DataFrame:
        """``(focus, value)``: distinct values at the end of the path; the focus itself without one."""
        at = focus.select(F.col("n").alias("focus"), terms.node(F.col("n")).alias("value"))
        if path is None:
            return at
        for p, inverse in path:
            step = self.quads.where(F.col("p") == p)
            step = step.select(F.col("o.key").alias("k"), terms.node(F.col("s")).alias("next")) if inverse else step.select(F.concat(F.lit("U:"), F.col("s")).alias("k"), F.col("o").alias("next"))
            at = at.join(step, at["value"]["key"] == step["k"]).select("focus", F.col("next").alias("value"))
        return at.withColumn("k", F.col("value.key")).dropDuplicates(["focus", "k"]).drop("k")

    def check(self, iri: str, focus: DataFrame, path_above: tuple[str, ...] = ()) -> DataFrame:
        """Violations of one shape at focus nodes ``(n)``."""
        shape = self.shapes[iri]
        values = self.values(focus, shape.path)
        shown = "/".join(("^" if inv else "") + p for p, inv in shape.path or []) or None
        parts = []

        def report(rows: DataFrame, component: str | Column, value: Column | None = None) -> None:
            name = F.lit(component) if isinstance(component, str) else component
            shown_name = F.concat(F.lit(SH), F.upper(F.substring(name, 1, 1)), F.substring(name, 2, 100), F.lit("ConstraintComponent"))
            parts.append(rows.select(
                "focus", F.lit(shown).cast("string").alias("path"), (value if value is not None else F.lit(None).cast(terms.TERM)).alias("value"), F.lit(iri).alias("shape"),
                shown_name.alias("component"), F.lit(shape.severity).alias("severity"), (F.lit(shape.message) if shape.message else name).alias("message"),
            ))

        v = F.col("value")
        # all tests of single values in one pass, all counts in another
        local = [(name, arg) for name, arg in shape.constraints if name not in ("minCount", "maxCount", "class", "node", "closed")]
        if local:
            broken = [F.when(~F.coalesce(self._holds(name, arg, v), F.lit(False)), F.lit(name)) for name, arg in local]
            report(values.withColumn("broken", F.explode(F.array_compact(F.array(*broken)))), F.col("broken"), v)
        limits = [(name, arg) for name, arg in shape.constraints if name in ("minCount", "maxCount")]
        if limits:
            counts = focus.select(F.col("n").alias("focus")).join(values.groupBy("focus").agg(F.count(F.lit(1)).alias("c")), "focus", "left")
            have = F.coalesce("c", F.lit(0))
            broken = [F.when(have < arg.value if name == "minCount" else have > arg.value, F.lit(name)) for name, arg in limits]
            report(counts.withColumn("broken", F.explode(F.array_compact(F.array(*broken)))), F.col("broken"))
        for name, arg in shape.constraints:
            if name == "class":
                good = self.below(arg.value).select(F.concat(F.lit("U:"), F.col("n")).alias("k"))
                report(values.withColumn("k", F.col("value.key")).join(good, "k", "left_anti"), name, v)
            elif name == "node":
                if arg.value in path_above or arg.value == iri:
                    continue
                nodes = values.where(v["kind"] == "U").select(F.col("value.str").alias("n")).distinct()
                bad = self.check(arg.value, nodes, (*path_above, iri)).select(F.concat(F.lit("U:"), F.col("focus")).alias("k")).distinct()
                report(values.withColumn("k", F.col("value.key")).join(bad, "k", "left_semi"), name, v)
            elif name == "closed":
                known = [p for q in shape.properties for p, inv in (self.shapes[q].path or [])[:1] if not inv] + arg
                own = self.quads.join(focus, F.col("s") == F.col("n"), "left_semi")
                report((own.where(~F.col("p").isin(*known)) if known else own).select(F.col("s").alias("focus"), F.col("o").alias("value")), name, v)
        for prop in shape.properties:
            if prop not in path_above:
                parts.append(self.check(prop, focus, (*path_above, iri)))
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], REPORT)

    def _holds(self, name: str, arg, v: Column) -> Column:
        text = terms.lexical(v)
        if name == "datatype":
            return terms.datatype(v) == arg.value
        if name == "nodeKind":
            kind = arg.value[len(SH) :]
            node = v["kind"] == "U"
            blank = node & F.contains(v["str"], F.lit("/.well-known/genid/"))
            return {"IRI": node & ~blank, "BlankNode": blank, "Literal": ~node, "BlankNodeOrIRI": node, "BlankNodeOrLiteral": blank | ~node, "IRIOrLiteral": ~blank}[kind]
        if name in ("minInclusive", "maxInclusive", "minExclusive", "maxExclusive"):
            b, equal = arg.column(), name.endswith("Inclusive")
            return terms.less(b, v, equal) if name.startswith("min") else terms.less(v, b, equal)
        if name == "pattern":
            pattern, flags = arg
            flags = "".join(c for c in flags if c in "smix")
            return text.rlike(f"(?{flags}){pattern}" if flags else pattern)
        if name in ("minLength", "maxLength"):
            return F.length(text) >= arg.value if name == "minLength" else F.length(text) <= arg.value
        return v["key"].isin(*[a.key() for a in arg]) if arg else F.lit(False)  # in

    def report(self, touched: DataFrame | None = None) -> DataFrame:
        """All violations; ``touched (s)`` limits focus nodes, as after a change."""
        scratch = Scratch(self.spark, "shapes")
        # focus nodes are used by every property of a shape
        parts = [self.check(iri, scratch.save(self.focus(s, touched), f"focus-{n}")) for n, (iri, s) in enumerate(self.shapes.items()) if s.targets]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], REPORT)


def validate(shape_rows: list[tuple[str, str, str, Value]], quads: DataFrame, adds: DataFrame | None = None, retracts: DataFrame | None = None) -> DataFrame:
    """The report over the quads, or over them with changes laid on top, then for touched nodes only."""
    touched = None
    if adds is not None or retracts is not None:
        cols = ["g", "s", "p", "o"]
        quads = quads.select(*cols)
        parts = [d.select("s") for d in (adds, retracts) if d is not None]
        touched = reduce(DataFrame.unionByName, parts).distinct()
        if retracts is not None:
            gone = retracts.select("g", "s", "p", F.col("o.key").alias("k"))
            quads = quads.withColumn("k", F.col("o.key")).join(gone, ["g", "s", "p", "k"], "left_anti").drop("k")
        quads = quads if adds is None else quads.unionByName(adds.select(*cols))
    return Validator(shapes(shape_rows), quads).report(touched)


def report_triples(report: DataFrame) -> DataFrame:
    """The report as triples ``(s, p, o)``, one result node a violation."""
    key = F.sha2(F.concat_ws("|", "focus", F.coalesce("path", F.lit("")), F.coalesce("value.key", F.lit("")), "shape", "component"), 256)
    node = F.concat(F.lit("urn:q:result:"), F.substring(key, 1, 32))
    pairs = [("focusNode", terms.node(F.col("focus"))), ("resultPath", terms.node(F.col("path"))), ("value", F.col("value")), ("sourceShape", terms.node(F.col("shape"))), ("sourceConstraintComponent", terms.node(F.col("component"))), ("resultSeverity", terms.node(F.col("severity"))), ("resultMessage", terms.text(F.col("message")))]
    each = F.array(*[F.struct(F.lit(SH + p).alias("p"), o.alias("o")) for p, o in pairs])
    return report.select(node.alias("s"), F.explode(each).alias("x")).select("s", "x.p", "x.o").where("o is not null")
