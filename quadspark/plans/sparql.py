"""SPARQL trees to DataFrames, on the same patterns and joins as the other languages."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadspark.functions import terms
from quadspark.functions.terms import XSD, Value
from quadspark.operators.snapshot import Snapshot, latest_annotations
from quadspark.plans.build import Builder, Solutions, join, union
from quadspark.plans.patterns import ANY, UNION, Graph, Pattern, Var
from quadspark.plans.sparql_parser import Select, parse

#: Functions whose value is a boolean, and comparisons read from the right.
TESTS = ("BOUND", "SAMETERM", "ISIRI", "ISURI", "ISLITERAL", "ISBLANK", "ISNUMERIC", "CONTAINS", "STRSTARTS", "STRENDS", "LANGMATCHES", "REGEX")
FLIPPED = {"=": "=", "!=": "!=", "<": ">", "<=": ">=", ">": "<", ">=": "<="}
NULL = lambda: F.lit(None).cast(terms.TERM)


@dataclass
class Result:
    """What a query gives: solutions, or triples ``(s, p, o)`` for CONSTRUCT and DESCRIBE, or one boolean."""

    form: str
    solutions: Solutions | None = None
    triples: DataFrame | None = None
    answer: bool | None = None

    def plain(self) -> DataFrame:
        """Variables as text columns."""
        return self.solutions.df.select(*[terms.plain(F.col(f"`{v}`")).alias(v) for v in self.solutions.vars])


class Sparql:
    def __init__(self, snapshot: Snapshot, spark, prefixes: dict[str, str] | None = None):
        self.snapshot, self.spark, self.prefixes = snapshot, spark, prefixes
        self.builder = Builder(snapshot, spark)
        self.default, self.named = UNION, None
        self.fresh = 0

    def run(self, query: str | Select, default_graphs: list[str] = (), named_graphs: list[str] = ()) -> Result:
        """Graphs given here override those that the query names."""
        q = parse(query, self.prefixes) if isinstance(query, str) else query
        dataset = list(default_graphs) or q.default_graphs, list(named_graphs) or q.named_graphs
        if dataset[0]:
            self.default = Graph("set", tuple(dataset[0]))
        elif dataset[1]:
            self.default = Graph("set", ())
        self.named = tuple(dataset[1]) or None
        if q.form == "SELECT":
            return Result("SELECT", self.select(q))
        body = self.select(replace(q, form="SELECT", items=None)) if q.form != "ASK" else self.group(q.where)
        if q.form == "ASK":
            return Result("ASK", answer=not body.df.limit(1).isEmpty())
        if q.form == "CONSTRUCT":
            return Result("CONSTRUCT", triples=self.construct(body, q.template))
        return Result("DESCRIBE", triples=self.describe(body, q.described))

    # --- solution modifiers --------------------------------------------------------------------

    def select(self, q: Select) -> Solutions:
        rows = self.group(q.where)
        aggregates = q.group or any(_has_aggregate(e) for _, e in q.items or []) or any(map(_has_aggregate, q.having))
        items = q.items if q.items is not None else [(v, ("var", v)) for v in rows.vars if not v.startswith("_")]
        if aggregates:
            rows, rewritten, having = self.aggregate(rows, q, items)
            items = [(name, e) for (name, _), e in zip(items, rewritten, strict=True)]
            for test in having:
                rows = rows.where(self.test(test, rows))
        for name, e in items:
            if e != ("var", name):
                rows = _with(rows, name, self.expr(e, rows))
        if q.order:
            keys = [terms.order_key(self.expr(e, rows)) for e, _ in q.order]
            rows = replace(rows, df=rows.df.orderBy(*[k.desc() if desc else k.asc() for k, (_, desc) in zip(keys, q.order, strict=True)]))
        rows = rows.select([name for name, _ in items])
        if q.distinct:
            rows = self.distinct(rows, q)
        df = rows.df
        df = df.offset(q.offset) if q.offset else df
        df = df.limit(q.limit) if q.limit is not None else df
        return replace(rows, df=df)

    def distinct(self, rows: Solutions, q: Select) -> Solutions:
        keys = [F.col(f"`{v}`")["key"].alias(f"__k{n}") for n, v in enumerate(rows.vars)]
        df = rows.df.select(*[f"`{v}`" for v in rows.vars], *keys).dropDuplicates([f"__k{n}" for n in range(len(keys))])
        out = replace(rows, df=df.select(*[f"`{v}`" for v in rows.vars]))
        if q.order:  # duplicates go through a shuffle, which loses the order
            known = [(e, d) for e, d in q.order if e[0] == "var" and e[1] in rows.vars]
            order = [terms.order_key(F.col(f"`{e[1]}`")).desc() if d else terms.order_key(F.col(f"`{e[1]}`")).asc() for e, d in known]
            out = replace(out, df=out.df.orderBy(*order)) if order else out
        return out

    def aggregate(self, rows: Solutions, q: Select, items: list) -> tuple[Solutions, list, list]:
        for name, e in q.group:
            if e != ("var", name):
                rows = _with(rows, name, self.expr(e, rows))
        keys = [name for name, _ in q.group]
        found: list[tuple] = []

        def rewrite(e):
            if isinstance(e, tuple) and e and e[0] == "agg":
                if e not in found:
                    found.append(e)
                return ("var", f"_agg{found.index(e)}")
            if isinstance(e, tuple):
                return tuple(rewrite(x) for x in e)
            return [rewrite(x) for x in e] if isinstance(e, list) else e

        exprs = [rewrite(e) for _, e in items]
        having = [rewrite(e) for e in q.having]
        group = [F.col(f"`{k}`")["key"].alias(f"__g{n}") for n, k in enumerate(keys) if k in rows.vars]
        firsts = [(F.min_by(F.col(f"`{k}`"), F.col(f"`{k}`")["key"]) if k in rows.vars else F.first(NULL())).alias(k) for k in keys]
        aggs = [self._agg(e, rows).alias(f"_agg{n}") for n, e in enumerate(found)]
        df = rows.df.groupBy(*group).agg(*(firsts + aggs or [F.count(F.lit(1)).alias("__n")]))
        names = [*keys, *[f"_agg{n}" for n in range(len(found))]]
        return Solutions(df.select(*[f"`{n}`" for n in names]), tuple(names), frozenset()), exprs, having

    def _agg(self, e: tuple, rows: Solutions) -> Column:
        _, name, distinct, inner, separator = e
        if inner is None:
            if distinct:
                return terms.integer(F.count_distinct(F.struct(*[F.coalesce(F.col(f"`{v}`")["key"], F.lit("")) for v in rows.vars])))
            return terms.integer(F.count(F.lit(1)))
        t = self.expr(inner, rows)
        key, num = t["key"], terms.number(t)
        if name == "COUNT":
            return terms.integer(F.count_distinct(key) if distinct else F.count(key))
        order = terms.order_key(t)
        if name in ("MIN", "MAX"):
            return (F.min_by if name == "MIN" else F.max_by)(t, F.when(key.isNotNull(), order))
        if name == "SAMPLE":
            return F.min_by(t, key)
        if name == "GROUP_CONCAT":
            # terms are put in order after they are gathered, so that each distinct one is looked at once
            texts = F.filter((F.collect_set if distinct else F.collect_list)(t), lambda x: terms.lexical(x).isNotNull())
            ordered = F.array_sort(F.transform(texts, lambda x: F.struct(terms.order_key(x).alias("o"), terms.lexical(x).alias("x"))))
            return terms.text(F.array_join(F.transform(ordered, lambda x: x["x"]), separator))
        # SUM and AVG: over distinct terms each counts once; one that is no number makes an error
        if distinct:
            # distinct integers and doubles are distinct terms; other numeric literals are rare enough for a set
            other = F.collect_set(F.when((t["kind"] == "T") & num.isNotNull(), F.struct(key.alias("k"), num.alias("n"))))
            zero = lambda c: F.coalesce(c, F.lit(0.0))
            n, bad = F.count_distinct(key), F.count(F.when(key.isNotNull() & num.isNull(), 1))
            total = zero(F.sum_distinct(t["int"].cast("double"))) + zero(F.sum_distinct(t["dbl"])) + F.aggregate(other, F.lit(0.0), lambda a, x: a + x["n"])
            ints = F.count_distinct(t["int"])
            whole = F.when(ints == n, F.coalesce(F.sum_distinct(t["int"]), F.lit(0).cast("long")))
        else:
            n, bad = F.count(key), F.count(F.when(key.isNotNull() & num.isNull(), 1))
            total, whole = F.coalesce(F.sum(num), F.lit(0.0)), F.when(F.count(F.when(t["int"].isNotNull(), 1)) == F.count(key), F.coalesce(F.try_sum(t["int"]), F.when(F.count(key) == 0, F.lit(0).cast("long"))))
        if name == "SUM":
            return F.when(bad > 0, NULL()).when(whole.isNotNull(), terms.integer(whole)).otherwise(terms.double(total))
        return F.when(bad > 0, NULL()).when(n == 0, terms.integer(F.lit(0).cast("long"))).otherwise(terms.double(total / n))

    # --- groups ------------------------------------------------------------------------------

    def group(self, node: tuple) -> Solutions:
        kind = node[0]
        if kind == "bgp":
            return self.builder.conjunction([self.scoped(p) for p in node[1]])
        if kind == "join":
            left, right = self.group(node[1]), node[2]
            # nodes that patterns of the same graphs bind are nodes there: no others need be looked for
            if right[0] == "path" and node[1][0] == "bgp" and isinstance(right[1], Var) and right[1].name in left.certain and right[4] == UNION and self._binds(node[1], right[1]):
                return join(left, self.path(right[1], right[2], right[3], right[4], left))
            return join(left, self.group(right))
        if kind == "union":
            return union(self.group(node[1]), self.group(node[2]))
        if kind == "filter":
            return self.filter(self.group(node[1]), node[2])
        if kind == "optional":
            left, right, tests = self.group(node[1]), node[2], []
            while right[0] == "filter":  # a filter of the optional part sees both sides
                tests.append(right[2])
                right = right[1]
            if any(_has_exists(t) for t in tests):
                return join(left, self.group(node[2]), "left")
            inner = self.group(right)
            also = None
            if tests:
                names = dict.fromkeys([*left.vars, *inner.vars])

                def also(col):
                    lookup = {v: col(v) for v in names}
                    return reduce(lambda a, b: a & b, [F.coalesce(self.test(t, None, lookup), F.lit(False)) for t in tests])

            return join(left, inner, "left", also)
        if kind == "minus":
            left, right = self.group(node[1]), self.group(node[2])
            shared = [v for v in left.vars if v in right.vars]
            return join(left, right.select(shared), "left_anti", overlap=True) if shared else left
        if kind == "bind":
            rows = self.group(node[1])
            return _with(rows, node[3], self.expr(node[2], rows))
        if kind == "values":
            return self.values(node[1], node[2])
        if kind == "path":
            return self.path(node[1], node[2], node[3], node[4])
        if kind == "star":
            return self.star(node)
        return self.select(node[1])  # a nested SELECT shows what it selects only

    @staticmethod
    def _binds(bgp: tuple, var: Var) -> bool:
        return any(p.graph == UNION and (p.hops is None or p.hops[0] > 0) and var in (p.s, p.o) for p in bgp[1])

    def scoped(self, p: Pattern) -> Pattern:
        return replace(p, graph=self.scope(p.graph))

    def scope(self, graph: Graph) -> Graph:
        if graph == UNION:
            return self.default
        if graph.kind == "named" and self.named:
            return Graph("set-named", self.named, graph.var)
        if graph.kind == "one" and self.named is not None and graph.iris[0] not in self.named:
            return Graph("set", ())
        return graph

    def filter(self, rows: Solutions, test: tuple) -> Solutions:
        if test[0] == "exists":
            inner = self.group(test[2])
            shared = [v for v in rows.vars if v in inner.vars]
            return join(rows, inner.select(shared), "left_anti" if test[1] else "left_semi")
        if test[0] == "op" and test[1] == "&&" and _has_exists(test):
            return self.filter(self.filter(rows, test[2][0]), test[2][1])
        if _has_exists(test):
            raise NotImplementedError("EXISTS within another expression than a conjunction")
        return rows.where(self.test(test, rows))

    def values(self, names: list[str], rows: list[list]) -> Solutions:
        cols = [F.array(*[F.struct(*[(NULL() if v is None else v.column()).alias(n) for n, v in zip(names, row, strict=True)]) for row in rows])] if rows else []
        certain = frozenset(n for k, n in enumerate(names) if all(r[k] is not None for r in rows))
        if not rows:
            df = self.spark.createDataFrame([], ", ".join(f"`{n}` {terms.TERM_DDL}" for n in names))
            return Solutions(df, tuple(names), certain)
        df = self.spark.range(1).select(F.explode(cols[0]).alias("x")).select("x.*")
        return Solutions(df, tuple(names), certain)

    def new(self) -> Var:
        self.fresh += 1
        return Var(f"_path{self.fresh}")

    def path(self, s, path: tuple, o, graph: Graph, among: Solutions | None = None) -> Solutions:
        kind = path[0]
        if kind == "pred":
            return self.builder.conjunction([self.scoped(Pattern(s, path[1], o, graph))])
        if kind == "inv":
            return self.path(o, path[1], s, graph)
        if kind == "seq":
            middle = self.new()
            out = join(self.path(s, path[1], middle, graph), self.path(middle, path[2], o, graph))
            return out.select([v for v in out.vars if v != middle.name])
        if kind == "alt":
            return union(self.path(s, path[1], o, graph), self.path(s, path[2], o, graph))
        if kind == "not":
            rows = self.snapshot.scan(s, ANY, o, self.scope(graph))
            parts = []
            if path[1] or not path[2]:
                keep = rows.where(~F.col("p").isin(*path[1])) if path[1] else rows
                parts.append(self.builder._bind(keep, Pattern(s, ANY, o)))
            if path[2]:
                back = self.snapshot.scan(o, ANY, s, self.scope(graph)).where(~F.col("p").isin(*path[2]))
                parts.append(self.builder._bind(back, Pattern(o, ANY, s)))
            return reduce(union, parts)
        _, inner, least, most = path
        a, b = self.new(), self.new()
        if inner[0] == "pred":
            return self.builder._path(self.scoped(Pattern(s, inner[1], o, graph, hops=(least, most))), among)
        pairs = self.path(a, inner, b, graph).df
        edges = pairs.where((F.col(a.name)["kind"] == "U") & (F.col(b.name)["kind"] == "U")).select(F.col(a.name)["str"].alias("s"), F.col(b.name)["str"].alias("o"))
        from quadspark.operators import recursion

        every = lambda: self.snapshot.scan(graph=self.scope(graph)).select(F.explode(F.array("s", F.when(F.col("o.kind") == "U", F.col("o.str")))).alias("n")).where("n is not null").distinct()
        ends = [t.value if isinstance(t, Value) else None for t in (s, o)]
        full = recursion.path(edges, least, most, every, *ends)
        rows = full.select(F.lit("").alias("g"), "s", F.lit("").alias("p"), terms.node(F.col("o")).alias("o"), F.lit(None).cast("string").alias("edge_id"))
        return self.builder._bind(rows, Pattern(s, ANY, o))

    def star(self, node: tuple) -> Solutions:
        """Annotations on a quoted triple, as subject, or the triples that annotate with it, as object."""
        _, position, subject, (s, p, o), predicate, value = node
        edge = self.new()
        base = self.builder.conjunction([self.scoped(Pattern(s, p, o, UNION, edge=edge.name))])
        notes = latest_annotations(self.snapshot.annotations) if self.snapshot.annotations is not None else None
        if position == "object":
            out = join(base, self.builder.conjunction([self.scoped(Pattern(subject, predicate, edge, UNION))]))
        else:
            if notes is None:
                raise ValueError("this store has no edge annotations")
            rows = notes.select(F.lit("").alias("g"), F.col("edge_id").alias("s"), "p", "o", F.lit(None).cast("string").alias("edge_id"))
            rows = rows.where(F.col("p") == predicate.value) if isinstance(predicate, Value) else rows
            rows = rows.where(F.col("o.key") == value.key()) if isinstance(value, Value) else rows
            out = join(base, self.builder._bind(rows, Pattern(edge, predicate, value)))
        return out.select([v for v in out.vars if v != edge.name])

    # --- other forms -----------------------------------------------------------------------------

    def construct(self, rows: Solutions, template: list[Pattern]) -> DataFrame:
        """Distinct triples of the template for every solution that binds it to valid ones."""
        def at(t):
            if isinstance(t, Value):
                return t.column()
            return F.col(f"`{t.name}`") if t.name in rows.vars else NULL()

        parts = []
        for p in template:
            s, pr, o = at(p.s), at(p.p), at(p.o)
            good = (s["kind"] == "U") & (pr["kind"] == "U") & o["key"].isNotNull()
            parts.append(rows.df.where(good).select(s["str"].alias("s"), pr["str"].alias("p"), o.alias("o")))
        if not parts:
            return self.spark.createDataFrame([], f"s string, p string, o {terms.TERM_DDL}")
        return reduce(DataFrame.unionByName, parts).withColumn("k", F.col("o.key")).dropDuplicates(["s", "p", "k"]).drop("k")

    def describe(self, rows: Solutions, described: list) -> DataFrame:
        """All triples out of the named nodes and of nodes that the variables are bound to."""
        names = [d.name for d in described if isinstance(d, Var)] if described else list(rows.vars)
        parts = [rows.df.where(F.col(f"`{n}`")["kind"] == "U").select(F.col(f"`{n}`")["str"].alias("n")) for n in names if n in rows.vars]
        fixed = [d.value for d in described if isinstance(d, Value)]
        if fixed:
            parts.append(self.spark.createDataFrame([(f,) for f in fixed], "n string"))
        nodes = reduce(DataFrame.unionByName, parts).distinct()
        quads = self.snapshot.scan(graph=self.default)
        return quads.join(nodes, quads.s == nodes.n, "left_semi").select("s", "p", "o")

    # --- expressions -----------------------------------------------------------------------------

    def expr(self, e: tuple, rows: Solutions | None, lookup: dict[str, Column] | None = None) -> Column:
        """A term column; an error is null, as is an unbound variable."""
        kind = e[0]
        if kind == "var":
            if lookup is not None:
                return lookup.get(e[1], NULL())
            return F.col(f"`{e[1]}`") if e[1] in rows.vars else NULL()
        if kind == "term":
            return e[1].column()
        if kind == "exists":
            raise NotImplementedError("EXISTS within an expression")
        if kind == "op" and e[1] in ("+", "-", "*", "/", "neg"):
            whole, real = self.whole(e, rows, lookup), self.real(e, rows, lookup)
            return F.when(whole.isNotNull(), terms.integer(whole)).otherwise(terms.double(real))
        if kind == "op" or e[1] in TESTS:
            return terms.boolean(self.test(e, rows, lookup))
        return self.call(e[1], [self.expr(a, rows, lookup) for a in e[2]])

    # Tests and numbers are built as plain columns and become terms at the end only: a term column names
    # its value several times, so nested terms would grow with every level.

    def test(self, e: tuple, rows: Solutions | None, lookup: dict[str, Column] | None = None) -> Column:
        """The boolean value of an expression."""
        if e[0] == "op" and e[1] in ("&&", "||"):
            x, y = (self.test(a, rows, lookup) for a in e[2])
            return x & y if e[1] == "&&" else x | y
        if e[0] == "op" and e[1] == "!":
            return ~self.test(e[2][0], rows, lookup)
        if e[0] == "op" and e[1] == "in":
            return reduce(lambda p, q: p | q, [self.compare("=", e[2][0], b, rows, lookup) for b in e[2][1:]], F.lit(False))
        if e[0] == "op" and e[1] in FLIPPED:
            return self.compare(e[1], *e[2], rows, lookup)
        if e[0] == "call" and e[1] in TESTS:
            return self.test_call(e[1], e[2], rows, lookup)
        return terms.truth(self.expr(e, rows, lookup))

    def whole(self, e: tuple, rows, lookup) -> Column:
        """The value of an expression over integers, null for any other."""
        if e[0] == "term":
            return F.lit(e[1].value if e[1].kind == "I" else None).cast("bigint")
        if e[0] == "op" and e[1] in ("+", "-", "*"):
            x, y = (self.whole(a, rows, lookup) for a in e[2])
            return {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[e[1]](x, y)
        if e[0] == "op" and e[1] == "neg":
            return F.try_subtract(F.lit(0).cast("bigint"), self.whole(e[2][0], rows, lookup))
        return F.lit(None).cast("bigint") if e[0] == "op" else self.expr(e, rows, lookup)["int"]

    def real(self, e: tuple, rows, lookup) -> Column:
        """The value of an expression as a double."""
        if e[0] == "term":
            return F.lit(float(e[1].value)) if e[1].kind in "ID" else terms.number(e[1].column())
        if e[0] == "op" and e[1] in ("+", "-", "*", "/"):
            x, y = (self.real(a, rows, lookup) for a in e[2])
            return {"+": x + y, "-": x - y, "*": x * y, "/": F.try_divide(x, y)}[e[1]]
        if e[0] == "op" and e[1] == "neg":
            return -self.real(e[2][0], rows, lookup)
        return terms.number(self.expr(e, rows, lookup))

    def compare(self, op: str, a: tuple, b: tuple, rows, lookup) -> Column:
        """A comparison; with a constant only what that can equal is looked at, so a filter can be pushed down."""
        if a[0] == "term" and b[0] != "term":
            return self.compare(FLIPPED[op], b, a, rows, lookup)
        if op == "!=":
            return ~self.compare("=", a, b, rows, lookup)
        act = {"=": lambda x, y: x == y, "<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}[op]
        if b[0] == "term" and a[0] != "term":
            c = b[1]
            if c.kind in "ID":
                number = act(self.real(a, rows, lookup), F.lit(float(c.value)))
                exact = F.coalesce(act(self.whole(a, rows, lookup), F.lit(c.value)), number) if c.kind == "I" else number
                if op == "=" and a[0] != "op":
                    return F.coalesce(exact, F.when(self.expr(a, rows, lookup)["kind"] == "U", F.lit(False)))
                return exact
            t = self.expr(a, rows, lookup)
            if c.kind == "U" and op == "=":
                return t["key"] == c.key()
            if c.kind == "S" or (c.kind == "T" and c.extra in terms.TEMPORAL_TYPES):
                alike = (t["kind"] == "S") if c.kind == "S" else (t["kind"] == "T") & (t["dt"] == c.extra)
                out = F.when(alike, act(t["str"], F.lit(c.value)))
                return out.when(t["kind"].isin("U", "L") if c.kind == "S" else t["kind"] == "U", F.lit(False)) if op == "=" else out
        arithmetic = any(x[0] == "op" and x[1] in ("+", "-", "*", "/", "neg") for x in (a, b))
        if arithmetic:
            return F.coalesce(act(self.whole(a, rows, lookup), self.whole(b, rows, lookup)), act(self.real(a, rows, lookup), self.real(b, rows, lookup)))
        x, y = self.expr(a, rows, lookup), self.expr(b, rows, lookup)
        return terms.equal(x, y) if op == "=" else terms.less(x, y, op == "<=") if op[0] == "<" else terms.less(y, x, op == ">=")

    def test_call(self, name: str, args: list[tuple], rows, lookup) -> Column:
        a = self.expr(args[0], rows, lookup)
        k = a["kind"]
        string = lambda t: F.when(t["kind"].isin("S", "L"), t["str"])
        if name == "BOUND":
            return a["key"].isNotNull()
        if name in ("ISIRI", "ISURI"):
            return k == "U"
        if name == "ISLITERAL":
            return k != "U"
        if name == "ISBLANK":  # blank nodes become IRIs at import
            return F.when(k.isNotNull(), F.lit(False))
        if name == "ISNUMERIC":
            return F.when(k.isNotNull(), terms.number(a).isNotNull())
        constant = args[1][1].value if args[1][0] == "term" and args[1][1].kind == "S" else None
        b = self.expr(args[1], rows, lookup)
        if name == "SAMETERM":
            return a["key"] == b["key"]
        other = F.lit(constant) if constant is not None else string(b)
        if name == "LANGMATCHES":
            tag, wanted = F.lower(string(a)), F.lower(other)
            return F.when(wanted == "*", tag != "").otherwise((tag == wanted) | F.startswith(tag, F.concat(wanted, F.lit("-"))))
        if name == "REGEX":
            flags = "" if len(args) < 3 else args[2][1].value if args[2][0] == "term" else None
            if flags is None:
                raise NotImplementedError("REGEX flags that are no constant")
            letters = "".join(c for c in flags if c in "smix")
            body = F.concat(F.lit("\\Q"), other, F.lit("\\E")) if "q" in flags else other
            return F.regexp_like(string(a), F.concat(F.lit(f"(?{letters})"), body) if letters else body)
        found = {"CONTAINS": F.contains, "STRSTARTS": F.startswith, "STRENDS": F.endswith}[name](string(a), other)
        # the second argument's language, if it has one, must be the first one's
        return found if constant is not None else F.when((b["kind"] == "S") | ((k == "L") & (F.lower(a["lang"]) == F.lower(b["lang"]))), found)

    def call(self, name: str, a: list[Column]) -> Column:
        k = a[0]["kind"] if a else None
        string = lambda t: F.when(t["kind"].isin("S", "L"), t["str"])
        like = lambda value: F.when(k == "L", terms.lang_text(value, a[0]["lang"])).otherwise(terms.text(value))
        if name == "STR":
            return terms.text(terms.lexical(a[0]))
        if name == "LANG":
            return terms.text(F.when(k == "L", a[0]["lang"]).when(k != "U", F.lit("")))
        if name == "DATATYPE":
            return terms.node(terms.datatype(a[0]))
        if name in ("IRI", "URI"):
            return terms.node(F.when(k.isin("U", "S"), a[0]["str"]))
        if name == "STRLEN":
            return terms.integer(F.length(string(a[0])).cast("long"))
        if name in ("UCASE", "LCASE"):
            return like((F.upper if name == "UCASE" else F.lower)(string(a[0])))
        if name == "SUBSTR":
            start = a[1]["int"].cast("int")
            length = a[2]["int"].cast("int") if len(a) > 2 else F.lit(1 << 30)
            return like(F.substring(string(a[0]), start, length))
        if name == "CONCAT":
            return terms.text(F.concat(*map(terms.lexical, a)))
        if name == "REPLACE":
            return like(F.regexp_replace(string(a[0]), string(a[1]), string(a[2])))
        if name in ("ABS", "CEIL", "FLOOR", "ROUND"):
            n = terms.number(a[0])
            real = {"ABS": F.abs(n), "CEIL": F.ceil(n), "FLOOR": F.floor(n), "ROUND": F.floor(n + 0.5)}[name]
            return F.when(k == "I", terms.integer(F.abs(a[0]["int"]) if name == "ABS" else a[0]["int"])).otherwise(terms.double(real.cast("double")))
        if name == "IF":
            return F.when(terms.truth(a[0]), a[1]).when(~terms.truth(a[0]), a[2])
        if name == "COALESCE":
            return F.coalesce(*[F.when(t["key"].isNotNull(), t) for t in a])
        if name in (XSD + "integer", XSD + "double", XSD + "decimal", XSD + "float", XSD + "string", XSD + "boolean"):
            return terms.literal(terms.lexical(a[0]), F.lit(None).cast("string"), F.lit(name))
        raise NotImplementedError(f"function {name}")


def _with(rows: Solutions, name: str, value: Column) -> Solutions:
    names = [v for v in rows.vars if v != name]
    return Solutions(rows.df.select(*[F.col(f"`{v}`") for v in names], value.alias(name)), (*names, name), rows.certain - {name})


def _walk(e):
    yield e
    if isinstance(e, (tuple, list)):
        for x in e:
            yield from _walk(x)


def _has_aggregate(e) -> bool:
    return any(isinstance(x, tuple) and x and x[0] == "agg" for x in _walk(e))


def _has_exists(e) -> bool:
    return any(isinstance(x, tuple) and x and x[0] == "exists" for x in _walk(e))
