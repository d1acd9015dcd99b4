"""A Cypher subset on the same patterns.

``[USE GRAPH <iri>] [CALL VECTOR_NEAR(n, 'space', k[, ef = N]) YIELD n[, score]] MATCH path[, path]
[WHERE ...] [WITH ... [WHERE ...]] RETURN item[, ...] [ORDER BY ...] [SKIP n] [LIMIT n]``, and the
writes CREATE, MERGE, SET and DELETE.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass, field
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadspark.functions import terms
from quadspark.functions.terms import RDF_TYPE, Value
from quadspark.operators.snapshot import Snapshot, latest_annotations
from quadspark.plans.build import Builder, Solutions, join, weight
from quadspark.plans.patterns import UNION, Graph, Pattern, Var, Vocabulary

_TOKENS = re.compile(
    r"""(?P<ws>\s+|//[^\n]*)|(?P<str>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<num>\d+\.\d+(?:[eE][+-]?\d+)?|\d+)
    |(?P<quoted>`[^`]*`)|(?P<iri><[A-Za-z][\w+.-]*:[^<>\s]*>)|(?P<param>\$\w+)|(?P<word>[A-Za-z_]\w*)
    |(?P<op>=~|<=|>=|<>|<-|->|\.\.|[-=<>()\[\]{}:,.*])""",
    re.X,
)
AGGREGATES = ("COUNT", "SUM", "AVG", "MIN", "MAX", "COLLECT")


@dataclass
class Query:
    paths: list = field(default_factory=list)
    nodes: dict = field(default_factory=dict)  # variable -> (label, properties)
    edges: set = field(default_factory=set)
    filters: list = field(default_factory=list)
    near: list = field(default_factory=list)  # (variable, space, k, score variable, breadth)
    items: list = field(default_factory=list)  # (name, expression)
    order: list = field(default_factory=list)
    skip: int | None = None
    limit: int | None = None
    graph: str | None = None
    names: list | None = None  # what WITH keeps
    writes: list = field(default_factory=list)


class Parser:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        while at < len(text):
            m = _TOKENS.match(text, at)
            if not m:
                raise SyntaxError(f"unexpected {text[at:at + 20]!r}")
            if m.lastgroup != "ws":
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.at, self.fresh = 0, itertools.count()
        self.q = Query()

    def peek(self, ahead: int = 0):
        k = self.at + ahead
        return self.tokens[k] if k < len(self.tokens) else ("end", "")

    def eat(self, text: str) -> bool:
        kind, have = self.peek()
        if (kind == "word" and have.upper() == text) or (kind == "op" and have == text):
            self.at += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.eat(text):
            raise SyntaxError(f"expected {text!r}, found {self.peek()[1]!r}")

    def name(self) -> str:
        kind, text = self.peek()
        if kind not in ("word", "quoted", "iri"):
            raise SyntaxError(f"expected a name, found {text!r}")
        self.at += 1
        return text[1:-1] if kind in ("quoted", "iri") else text

    def value(self):
        kind, text = self.peek()
        minus = self.eat("-")
        kind, text = self.peek()
        self.at += 1
        if kind == "num":
            number = float(text) if "." in text else int(text)
            return Value.of(-number if minus else number)
        if kind == "str":
            return Value("S", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1]))
        if kind == "param":
            return ("param", text[1:])
        if kind == "word" and text.upper() in ("TRUE", "FALSE"):
            return Value("B", text.upper() == "TRUE")
        raise SyntaxError(f"expected a value, found {text!r}")

    def parse(self) -> Query:
        q = self.q
        if self.eat("USE"):
            self.need("GRAPH")
            q.graph = self.name()
        while self.eat("CALL"):
            self.near(True)
        while self.eat("MATCH"):
            while True:
                q.paths += self.path()
                if not self.eat(","):
                    break
        if self.eat("WHERE"):
            q.filters.append(self.either())
        if self.eat("WITH"):
            q.names = [self.name()]
            while self.eat(","):
                q.names.append(self.name())
            if self.eat("WHERE"):
                q.filters.append(self.either())
        while self.peek()[1].upper() in ("CREATE", "MERGE", "SET", "DELETE"):
            self.write(self.peek()[1].upper())
        if self.eat("RETURN"):
            self.eat("DISTINCT")
            while True:
                expr = self.item()
                q.items.append((self.name() if self.eat("AS") else _label(expr), expr))
                if not self.eat(","):
                    break
            if self.eat("ORDER"):
                self.need("BY")
                while True:
                    expr = self.item()
                    q.order.append((expr, self.eat("DESC")))
                    self.eat("ASC")
                    if not self.eat(","):
                        break
            q.skip = int(self.value().value) if self.eat("SKIP") else None
            q.limit = int(self.value().value) if self.eat("LIMIT") else None
        if self.peek()[0] != "end":
            raise SyntaxError(f"unexpected {self.peek()[1]!r}")
        if not q.items and not q.writes:
            raise SyntaxError("a query returns something or writes something")
        return q

    def near(self, call: bool) -> None:
        if self.name().upper() != "VECTOR_NEAR":
            raise SyntaxError("VECTOR_NEAR is the only procedure")
        self.need("(")
        var = self.name()
        self.need(",")
        space = self.value().value
        self.need(",")
        k, ef = self.value().value, None
        if self.eat(","):
            self.need("EF")
            self.need("=")
            ef = self.value().value
        self.need(")")
        score = None
        if call:
            self.need("YIELD")
            var = self.name()
            score = self.name() if self.eat(",") else None
        self.q.near.append((var, space, k, score, ef))

    def node(self) -> str:
        self.need("(")
        var = self.name() if self.peek()[0] in ("word", "quoted") else f"_n{next(self.fresh)}"
        label = self.name() if self.eat(":") else None
        props = self.props() if self.peek()[1] == "{" else {}
        self.need(")")
        old = self.q.nodes.get(var, (None, {}))
        self.q.nodes[var] = (label or old[0], {**old[1], **props})
        return var

    def props(self) -> dict:
        self.need("{")
        out = {}
        while not self.eat("}"):
            key = self.name()
            self.need(":")
            out[key] = self.value()
            self.eat(",")
        return out

    def path(self) -> list:
        out, left = [], self.node()
        while self.peek()[1] in ("-", "<-"):
            back = self.eat("<-")
            if not back:
                self.need("-")
            self.need("[")
            edge = self.name() if self.peek()[0] in ("word", "quoted") else None
            self.need(":")
            kind, hops = self.name(), None
            if self.eat("*"):
                hops = (1, None)
                if self.peek()[0] == "num":
                    first = int(self.value().value)
                    hops = (1, first)
                    if self.eat(".."):
                        hops = (first, int(self.value().value) if self.peek()[0] == "num" else None)
                elif self.eat(".."):
                    hops = (1, int(self.value().value))
            self.need("]")
            self.need("-" if back else "->")
            right = self.node()
            if edge:
                self.q.edges.add(edge)
            out.append((right, kind, left, edge, hops) if back else (left, kind, right, edge, hops))
            left = right
        return out

    def either(self) -> tuple:
        node = self.both()
        while self.eat("OR"):
            node = ("or", node, self.both())
        return node

    def both(self) -> tuple:
        node = self.test()
        while self.eat("AND"):
            node = ("and", node, self.test())
        return node

    def test(self) -> tuple:
        if self.eat("NOT"):
            return ("not", self.test())
        if self.eat("("):
            node = self.either()
            self.need(")")
            return node
        if self.peek()[1].upper() == "VECTOR_NEAR":
            self.near(False)
            return ("true",)
        var = self.name()
        self.need(".")
        prop = self.name()
        if self.eat("CONTAINS"):
            return ("contains", var, prop, self.value())
        if self.eat("STARTS"):
            self.need("WITH")
            return ("starts", var, prop, self.value())
        for op in ("=~", "<=", ">=", "<>", "=", "<", ">"):
            if self.eat(op):
                return (op, var, prop, self.value())
        raise SyntaxError(f"unexpected {self.peek()[1]!r}")

    def item(self) -> tuple:
        name = self.name()
        if self.eat("("):
            upper = name.upper()
            if upper in AGGREGATES:
                distinct = self.eat("DISTINCT")
                inner = None if self.eat("*") else self.item()
                self.need(")")
                return ("agg", upper, inner, distinct)
            if upper in ("ID", "ELEMENTID"):
                inner = self.name()
                self.need(")")
                return ("id", inner, name)
            raise SyntaxError(f"unknown function {name}")
        return ("prop", name, self.name()) if self.eat(".") else ("var", name)

    def write(self, word: str) -> None:
        self.at += 1
        if word in ("CREATE", "MERGE"):
            before, self.q.nodes = self.q.nodes, dict(self.q.nodes)
            known = set(before)
            hold, self.q.nodes = self.q.nodes, {}
            edges = self.path()
            made, self.q.nodes = self.q.nodes, hold
            self.q.writes.append((word, {v: n for v, n in made.items() if v not in known}, edges))
        elif word == "SET":
            while True:
                var = self.name()
                self.need(".")
                prop = self.name()
                self.need("=")
                self.q.writes.append(("SET", var, prop, self.value()))
                if not self.eat(","):
                    break
        else:
            self.q.writes.append(("DELETE", self.name()))
            while self.eat(","):
                self.q.writes.append(("DELETE", self.name()))


def _label(e: tuple) -> str:
    if e[0] == "agg":
        return f"{e[1].lower()}({'*' if e[2] is None else _label(e[2])})"
    return e[1] if e[0] == "var" else f"{e[2]}({e[1]})" if e[0] == "id" else f"{e[1]}.{e[2]}"


@lru_cache(maxsize=512)
def parse(text: str) -> Query:
    """The query's tree; trees are cached by text, and names are resolved when they run."""
    return Parser(text).parse()


class Cypher:
    def __init__(self, snapshot: Snapshot, spark, vocabulary: Vocabulary | None = None, vectors=None, graphs: list[str] | None = None):
        self.snapshot, self.spark, self.vocabulary = snapshot, spark, vocabulary or Vocabulary()
        self.builder = Builder(snapshot, spark)
        self.vectors = vectors  # (space, k, candidate nodes or None) -> DataFrame (node, score)
        self.graph = Graph("set", tuple(graphs)) if graphs else UNION

    def run(self, text: str, params: dict | None = None) -> DataFrame:
        q = parse(text)
        rows = self.bindings(q, params or {})
        return self.project(q, rows)

    def constant(self, v, params: dict) -> Value:
        if isinstance(v, Value):
            return v
        if v[1] not in params:
            raise KeyError(f"parameter ${v[1]} has no value")
        return Value.of(params[v[1]])

    def bindings(self, q: Query, params: dict) -> Solutions:
        graph = Graph("one", (q.graph,)) if q.graph else self.graph
        expand = self.vocabulary.expand
        patterns = [
            Pattern(Var(a), Value("U", expand(kind)), Var(b), graph, edge, hops, nodes_only=True) for a, kind, b, edge, hops in q.paths
        ]
        for var, (label, props) in q.nodes.items():
            if label:
                patterns.append(Pattern(Var(var), Value("U", RDF_TYPE), Value("U", expand(label)), graph))
            patterns += [Pattern(Var(var), Value("U", expand(k)), self.constant(v, params), graph) for k, v in props.items()]
        bound = {v for p in patterns for v in p.vars()}
        free = [v for v in q.nodes if v not in bound and not any(v == n[0] for n in q.near)]
        seed = self.candidates(q, patterns)
        # a value test on a node becomes a semi-join before the joins that multiply rows
        rows = self.builder.conjunction(patterns, seed, keep=None if free or seed else self.kept(q))
        for v in free:
            every = self.snapshot.scan(graph=graph).select(terms.node(F.col("s")).alias(v)).groupBy(F.col(v)["key"]).agg(F.first(v).alias(v)).select(v)
            rows = join(rows, Solutions(every, (v,), frozenset([v])))
        for f in q.filters:
            rows = self.filter(q, rows, f, params, graph)
        return rows

    def kept(self, q: Query) -> set[str] | None:
        """Variables that an aggregation needs, all else being counted; None if all rows are needed."""
        exprs = [e for _, e in q.items] + [e for e, _ in q.order]
        if q.writes or not any(e[0] == "agg" for e in exprs) or any(e[0] == "agg" and not e[3] and e[1] == "COLLECT" or e[0] == "agg" and e[3] and e[2] is None for e in exprs):
            return None
        inner = [e[2] if e[0] == "agg" else e for e in exprs]

        def tested(t: tuple) -> set[str]:
            return set().union(*map(tested, t[1:])) if t[0] in ("and", "or", "not") else {t[1]} if len(t) == 4 else set()

        return {e[1] for e in inner if e is not None}.union(*map(tested, q.filters), q.edges)

    def candidates(self, q: Query, patterns: list[Pattern]) -> Solutions | None:
        seed = None
        for var, space, k, score, ef in q.near:
            allowed = None
            own = [p for p in patterns if p.vars() == [var]]
            if own:  # filters on the node alone come before the ranking, so k results are found if there are k
                allowed = self.builder.conjunction(own).df.select(F.col(f"`{var}`")["str"].alias("node")).distinct()
            hits = self.vectors(space, k, allowed, **({"ef": ef} if ef else {}))
            names = [var] + ([score] if score else [])
            df = hits.select(terms.node(F.col("node")).alias(var), *([terms.double(F.col("score")).alias(score)] if score else []))
            found = Solutions(df, tuple(names), frozenset(names))
            seed = found if seed is None else join(seed, found)
        return seed

    def holders(self, q: Query, test: tuple, params: dict, graph: Graph) -> tuple[str, DataFrame]:
        """Variable of a test, and keys ``(k)`` of the nodes or edges that pass it."""
        op, var, prop, raw = test
        if var in q.edges:
            return var, self.edge_holders([test], params)
        rows = self.snapshot.scan(p=Value("U", self.vocabulary.expand(prop)), graph=graph)
        keys = rows.where(self.holds(op, F.col("o"), self.constant(raw, params), False)).select(F.concat(F.lit("U:"), F.col("s")).alias("k"))
        return var, keys if self.snapshot.one_value(self.vocabulary.expand(prop)) else keys.distinct()

    def edge_holders(self, tests: list[tuple], params: dict) -> DataFrame:
        """Keys ``(k)`` of the edges whose latest annotations pass all tests: one aggregation by edge."""
        names = [self.vocabulary.expand(t[2]) for t in tests]
        notes = self.snapshot.annotations.where(F.col("p").isin(*set(names)))
        latest = [F.max_by(F.when(F.col("p") == name, F.col("o")), F.when(F.col("p") == name, F.struct("tt", F.col("o.key")))).alias(f"o{n}") for n, name in enumerate(names)]
        held = [self.holds(t[0], F.col(f"o{n}"), self.constant(t[3], params), True) for n, t in enumerate(tests)]
        rows = notes.groupBy("edge_id").agg(*latest).where(reduce(lambda a, b: a & b, held))
        return rows.select(F.concat(F.lit("U:"), F.col("edge_id")).alias("k"))

    def holds(self, op: str, o: Column, value: Value, on_edge: bool) -> Column:
        """Whether a value passes a test."""
        v = value.column()
        text = F.when(o["kind"].isin("S", "L"), o["str"])
        if op == "=":
            hit = (o["key"] == value.key()) | ((text == v["str"]) if on_edge else F.lit(False))
        elif op == "contains":
            hit = F.contains(text, v["str"])
        elif op == "starts":
            hit = F.startswith(text, v["str"])
        elif op == "=~":
            pattern = java_pattern(value.value, self.spark)
            hit = F.lit(False) if pattern is None else text.rlike(pattern)
        else:
            a = F.when(o["kind"] == "L", terms.text(o["str"])).otherwise(o)
            hit = {"<": terms.less(a, v), "<=": terms.less(a, v, True), ">": terms.less(v, a), ">=": terms.less(v, a, True), "<>": ~terms.equal(a, v)}[op]
        return hit

    def filter(self, q: Query, rows: Solutions, test: tuple, params: dict, graph: Graph) -> Solutions:
        """Conjunctions are semi-joins; what is below OR or NOT becomes a flag first."""
        if test[0] == "true":
            return rows
        if test[0] == "and":
            flat = _conjuncts(test)
            on_edge = [t for t in flat if len(t) == 4 and t[1] in q.edges]
            for var in dict.fromkeys(t[1] for t in on_edge):
                keys = self.edge_holders([t for t in on_edge if t[1] == var], params)
                rows = Solutions(rows.df.join(keys, F.col(f"`{var}`")["key"] == F.col("k"), "left_semi"), rows.vars, rows.certain)
            for t in flat:
                rows = rows if t in on_edge else self.filter(q, rows, t, params, graph)
            return rows
        if test[0] not in ("or", "not"):
            var, keys = self.holders(q, test, params, graph)
            return Solutions(rows.df.join(keys, F.col(f"`{var}`")["key"] == F.col("k"), "left_semi"), rows.vars, rows.certain)
        df, count = rows.df, itertools.count()

        def flag(t: tuple) -> Column:
            nonlocal df
            if t[0] in ("or", "and"):
                a, b = flag(t[1]), flag(t[2])
                return a | b if t[0] == "or" else a & b
            if t[0] == "not":
                return ~flag(t[1])
            if t[0] == "true":
                return F.lit(True)
            n = f"__f{next(count)}"
            var, keys = self.holders(q, t, params, graph)
            df = df.join(keys.select(F.col("k").alias(n)).distinct(), F.col(f"`{var}`")["key"] == F.col(n), "left")
            return F.col(n).isNotNull()

        test_column = flag(test)
        return Solutions(df.where(test_column).select(*[f"`{v}`" for v in rows.vars]), rows.vars, rows.certain)

    # --- results -----------------------------------------------------------------------------------

    def project(self, q: Query, rows: Solutions) -> DataFrame:
        """Columns named as the items; values as text, numbers of aggregates as they are."""
        df, made = rows.df, {}
        exprs = [e for _, e in q.items] + [e for e, _ in q.order]
        inner = [x for e in exprs for x in ([e[2]] if e[0] == "agg" and e[2] else [e])]
        for e in inner:
            if e[0] == "prop" and e not in made:
                name = f"__p{len(made)}"
                df = self._with_property(q, df, e, name)
                made[e] = name

        def term(e: tuple) -> Column:
            if e[0] == "prop":
                return F.col(made[e])
            if e[1] not in rows.vars:
                raise KeyError(f"{e[1]} is not bound")
            return F.col(f"`{e[1]}`")

        aggregates = [(n, e) for n, e in q.items if e[0] == "agg"]
        names = [n for n, _ in q.items]
        if aggregates:
            keys = [(n, e) for n, e in q.items if e[0] != "agg"]
            # all that is shown or sorted by is a key, so that the aggregation can hash
            ordered = [e for e, _ in q.order]
            sorts = [i for i, (n, e) in enumerate(keys) if e in ordered or ("var", n) in ordered]
            group = [c for i, (n, e) in enumerate(keys) for c in (term(e)["key"].alias(f"__g{i}"), terms.plain(term(e)).alias(n))]
            group += [terms.order_key(term(keys[i][1])).alias(f"__k{i}") for i in sorts]
            out = df.groupBy(*group).agg(*[_aggregate(e, term, weight(rows)).alias(n) for n, e in aggregates])
            order_of = {**{n: F.col(f"__k{i}") for i, (n, _) in enumerate(keys)}, **{n: F.col(f"`{n}`") for n, _ in aggregates}}
            by_expr = {e: order_of[n] for n, e in q.items}
        else:
            out = df.select(*[terms.plain(term(e)).alias(n) for n, e in q.items], *[terms.order_key(term(e)).alias(f"__o{i}") for i, (e, _) in enumerate(q.order) if e not in [("var", n) for n in names] or e[1] in rows.vars])
            order_of, by_expr = {n: terms.order_key(term(e)) for n, e in q.items}, {}
        if q.order:
            keys = []
            for i, (e, desc) in enumerate(q.order):
                key = by_expr.get(e) if e in by_expr else order_of.get(e[1]) if aggregates and e[0] == "var" else F.col(f"__o{i}")
                keys.append(key.desc_nulls_last() if desc else key.asc_nulls_first())
            out = out.orderBy(*keys)
        out = out.offset(q.skip) if q.skip else out
        out = out.limit(q.limit) if q.limit is not None else out
        return out.select(*[f"`{n}`" for n in names])

    def _with_property(self, q: Query, df: DataFrame, e: tuple, name: str) -> DataFrame:
        """The property's value beside each row: of several the least key, of an edge the latest annotation."""
        p = self.vocabulary.expand(e[2])
        if e[1] in q.edges:
            values = latest_annotations(self.snapshot.annotations).where(F.col("p") == p).select(F.concat(F.lit("U:"), F.col("edge_id")).alias("__s"), F.col("o").alias(name))
        else:
            found = self.snapshot.scan(p=Value("U", p), graph=Graph("one", (q.graph,)) if q.graph else self.graph)
            subject = F.concat(F.lit("U:"), F.col("s")).alias("__s")
            values = found.select(subject, F.col("o").alias(name)) if self.snapshot.one_value(p) else found.groupBy(subject).agg(F.min_by("o", F.col("o.key")).alias(name))
        return df.join(values, F.col(f"`{e[1]}`")["key"] == F.col("__s"), "left").drop("__s")


def _conjuncts(test: tuple) -> list[tuple]:
    return [*_conjuncts(test[1]), *_conjuncts(test[2])] if test[0] == "and" else [test]


def _aggregate(e: tuple, term, times: Column) -> Column:
    """Sums and means are doubles over what is numeric; COLLECT is a sorted list as JSON text. ``times`` is
    how many solutions a row stands for."""
    _, name, inner, distinct = e
    if inner is None:
        return F.coalesce(F.sum(times), F.lit(0).cast("long"))
    t = term(inner)
    num = terms.number(t)
    if name == "COUNT":
        return F.count_distinct(t["key"]) if distinct else F.coalesce(F.sum(F.when(t["key"].isNotNull(), times)), F.lit(0).cast("long"))
    if name == "COLLECT":
        gather = F.collect_set if distinct else F.collect_list
        return F.to_json(F.array_sort(gather(terms.lexical(t))))
    if name == "SUM":
        return F.coalesce(F.sum_distinct(num) if distinct else F.sum(num * times), F.lit(0.0))
    if name == "AVG":
        return F.sum(num * times) / F.sum(F.when(num.isNotNull(), times))
    return {"MIN": F.min, "MAX": F.max}[name](num)


#: POSIX classes in brackets, as Java spells them.
_POSIX = {"alpha": "Alpha", "digit": "Digit", "alnum": "Alnum", "upper": "Upper", "lower": "Lower", "punct": "Punct", "graph": "Graph", "print": "Print", "blank": "Blank", "cntrl": "Cntrl", "xdigit": "XDigit", "space": "Space"}
_POSIX_CLASS = re.compile(r"\[:(\^?)(\w+):\]")


def java_pattern(pattern: str, spark) -> str | None:
    """A pattern in the syntax of the engine that runs it, or None if it is not valid: what a linear-time
    matcher does not take (looking around, back references, atomic groups) is not."""
    out, at, depth, names = [], 0, 0, 0
    while at < len(pattern):
        rest = pattern[at:]
        if rest[0] == "\\":
            if len(rest) < 2 or rest[1] in "123456789kGZ":
                return None
            braced = re.match(r"\\[uU]\{([0-9A-Fa-f]{1,8})\}", rest)
            out.append(f"\\x{{{braced[1]}}}" if braced else rest[:2])
            at += len(braced[0]) if braced else 2
        elif depth and (posix := _POSIX_CLASS.match(rest)):
            if posix[2] not in _POSIX:
                return None
            out.append(f"\\{'P' if posix[1] else 'p'}{{{_POSIX[posix[2]]}}}")
            at += len(posix[0])
        elif rest[0] in "[]":
            depth += 1 if rest[0] == "[" else -1 if depth else 0
            out.append(rest[0])
            at += 1
            # a bracket right after the opening one is a character
            if rest[0] == "[" and (first := re.match(r"\^?\]", pattern[at:])):
                out.append(first[0].replace("]", "\\]"))
                at += len(first[0])
        elif not depth and (named := re.match(r"\(\?P?<(\w+)>", rest)):
            out.append(f"(?<g{names}>")  # names are of no use in a test, and Java takes fewer
            names += 1
            at += len(named[0])
        elif not depth and re.match(r"\(\?(?:[=!>]|<[=!])", rest):
            return None
        else:
            out.append(rest[0])
            at += 1
    try:
        spark._jvm.java.util.regex.Pattern.compile("".join(out))
    except Exception:  # py4j wraps PatternSyntaxException
        return None
    return "".join(out)
