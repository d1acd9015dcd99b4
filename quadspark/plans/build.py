"""Patterns to DataFrames.

A solution set is a DataFrame with one term column per variable. Variables that every row binds are
``certain``; a join on those alone is an equi-join on keys, which Catalyst plans as it likes.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadspark.functions import terms
from quadspark.functions.terms import RDF_TYPE
from quadspark.operators import recursion
from quadspark.operators.ontology import Registry, schema_allows
from quadspark.operators.snapshot import Snapshot
from quadspark.plans.patterns import UNION, Pattern, Query, Rule, Value, Var
from quadspark.scratch import Scratch


#: Prefix of variables that are counts of equal rows.
WEIGHT = "__w_"


@dataclass(frozen=True)
class Solutions:
    df: DataFrame
    vars: tuple[str, ...]
    certain: frozenset[str]

    def select(self, names: list[str]) -> Solutions:
        """These variables only; one that nothing binds is unbound in every row."""
        cols = [F.col(f"`{n}`") if n in self.vars else F.lit(None).cast(terms.TERM).alias(n) for n in names]
        return Solutions(self.df.select(*cols), tuple(names), self.certain & set(names))

    def where(self, test) -> Solutions:
        return replace(self, df=self.df.where(test))


def one_row(spark) -> Solutions:
    return Solutions(spark.range(1).select(), (), frozenset())


def join(a: Solutions, b: Solutions, how: str = "inner", also=None, overlap: bool = False) -> Solutions:
    """Rows of both that agree on shared variables; an unbound variable agrees with anything.

    ``how`` left keeps rows of ``a`` without a partner, left_semi and left_anti keep rows with and without
    one. ``also(column of name)`` is a further condition that sees both sides; ``overlap`` asks that a
    shared variable be bound on both. Without a shared variable that is always bound, rows that bind all
    shared ones are joined on their keys, and only the others by the looser test.
    """
    shared = [v for v in a.vars if v in b.vars]
    right = b.df.select(*[F.col(f"`{v}`").alias(f"__r_{v}") for v in b.vars])
    pick = {v: F.coalesce(F.col(f"`{v}`"), F.col(f"`__r_{v}`")) if v in shared and v not in a.certain else F.col(f"`{v}`") if v in a.vars else F.col(f"`__r_{v}`") for v in dict.fromkeys([*a.vars, *b.vars])}
    left_key, right_key = (lambda v: F.col(f"`{v}`")["key"]), (lambda v: F.col(f"`__r_{v}`")["key"])
    extra = [F.coalesce(also(lambda v: pick.get(v)), F.lit(False))] if also is not None else []

    def test(bound_left: bool, bound_right: bool):
        """The condition, for sides whose shared variables are all bound or perhaps not."""
        tests = []
        for v in shared:
            x, y = left_key(v), right_key(v)
            loose = ([] if bound_left or v in a.certain else [x.isNull()]) + ([] if bound_right or v in b.certain else [y.isNull()])
            tests.append(reduce(lambda p, q: p | q, loose, x == y))
        if overlap and not ((bound_left and bound_right) or any(v in a.certain and v in b.certain for v in shared)):
            tests.append(reduce(lambda p, q: p | q, [left_key(v).isNotNull() & right_key(v).isNotNull() for v in shared], F.lit(False)))
        tests += extra
        return reduce(lambda p, q: p & q, tests) if tests else F.lit(True)

    certain = a.certain | b.certain if how == "inner" else a.certain
    result = lambda df: Solutions(df.select(*[c.alias(v) for v, c in pick.items()]), tuple(pick), frozenset(certain))
    whole = not shared or all(v in a.certain and v in b.certain for v in shared)
    if whole or any(v in a.certain and v in b.certain for v in shared):
        on = test(whole, whole)
        if how in ("left_anti", "left_semi"):
            return replace(a, df=a.df.join(right, on, how))
        # patterns without a shared variable are a product by definition
        return result(a.df.join(right, on, how) if shared or extra or how == "left" else a.df.crossJoin(right))
    loose = [v for v in shared if v not in a.certain or v not in b.certain]
    if how in ("left_anti", "left_semi") and also is None and len(loose) <= MAX_LOOSE:
        return replace(a, df=_by_bound(a, right, shared, how, overlap, b.certain))
    all_bound = lambda key: reduce(lambda p, q: p & q, [key(v).isNotNull() for v in shared])
    parts = {}
    for side, df, key, known in (("a", a.df, left_key, a.certain), ("b", right, right_key, b.certain)):
        every = set(shared) <= known
        parts[side] = df if every else df.where(all_bound(key)), None if every else df.where(~all_bound(key))
    (a_full, a_part), (b_full, b_part) = parts["a"], parts["b"]

    def kept(how: str) -> DataFrame:
        """Rows of ``a`` with a partner, or without one."""
        out = a_full.join(b_full, test(True, True), how)
        if b_part is not None:
            alone = out if how == "left_anti" else a_full.join(b_full, test(True, True), "left_anti")
            more = alone.join(b_part, test(True, False), how)
            out = more if how == "left_anti" else out.unionByName(more)
        return out if a_part is None else out.unionByName(a_part.join(right, test(False, False), how))

    if how in ("left_anti", "left_semi"):
        return replace(a, df=kept(how))
    out = a_full.join(b_full, test(True, True))
    out = out if b_part is None else out.unionByName(a_full.join(b_part, test(True, False)))
    out = out if a_part is None else out.unionByName(a_part.join(right, test(False, False)))
    if how == "left":
        missing = kept("left_anti").select("*", *[F.lit(None).cast(terms.TERM).alias(c) for c in right.columns])
        out = out.unionByName(missing)
    return result(out)


#: Shared variables that may be unbound, up to which rows are joined apart by which of them they bind.
MAX_LOOSE = 3


def _by_bound(a: Solutions, right: DataFrame, shared: list[str], how: str, overlap: bool, certain: frozenset[str]) -> DataFrame:
    """Rows of ``a`` with a partner, or without one, among ``right``: rows are taken apart by the variables
    that they bind, so that each join is on the keys of what both sides bind."""
    left_key, right_key = (lambda v: F.col(f"`{v}`")["key"]), (lambda v: F.col(f"`__r_{v}`")["key"])
    keys = right.select(*[right_key(v).alias(f"__k{n}") for n, v in enumerate(shared)]).distinct()

    def masks(sure) -> list[frozenset[str]]:
        open_ = [v for v in shared if v not in sure]
        return [frozenset(v for v in shared if v not in open_ or bits >> open_.index(v) & 1) for bits in range(1 << len(open_))]

    def having(df: DataFrame, column, mask: frozenset[str], sure) -> DataFrame:
        return reduce(DataFrame.where, [column(v).isNotNull() if v in mask else column(v).isNull() for v in shared if v not in sure], df)

    out = []
    for mine in masks(a.certain):
        rows = having(a.df, left_key, mine, a.certain)
        for theirs in masks(certain):
            both = [v for v in shared if v in mine & theirs]
            if overlap and not both:  # nothing that both bind: no partner
                continue
            some = having(keys, lambda v: F.col(f"__k{shared.index(v)}"), theirs, certain).select(*[f"__k{shared.index(v)}" for v in both]).distinct()
            some = some if both else some.limit(1)
            on = reduce(lambda p, q: p & q, [left_key(v) == F.col(f"__k{shared.index(v)}") for v in both], F.lit(True))
            found = rows.join(some, on, how)
            if how == "left_semi":
                out.append(found)
                rows = rows.join(some, on, "left_anti")
            else:
                rows = found
        if how == "left_anti":
            out.append(rows)
    return reduce(DataFrame.unionByName, out) if out else a.df.where(F.lit(False))


#: Fixed value: rows of one key on either side that meet in one cell of :func:`spread_join`.
CELL = 1024
#: Fixed value: pairs that one task makes, by count, and the most tasks that this asks for.
TASK_PAIRS, MOST_TASKS = 1 << 22, 20_000


def spread_join(a: Solutions, b: Solutions) -> Solutions:
    """The inner join where both sides may have many rows of one key.

    Rows of a key beyond ``CELL`` are dealt into parts, and each part of one side meets each part of the
    other: no task has much more than ``CELL`` times ``CELL`` pairs of a key, and what is copied for that is
    the number of pairs divided by ``CELL``.
    """
    shared = [v for v in a.vars if v in b.vars]
    if not shared or not all(v in a.certain and v in b.certain for v in shared):
        return join(a, b)
    names = [f"__k{n}" for n in range(len(shared))]
    hashed = lambda x: F.xxhash64(*[F.col(f"`{v}`")["key"] for v in x.vars if v in x.certain and not v.startswith(WEIGHT)])
    keyed = lambda x: x.df.select(*[f"`{v}`" for v in x.vars], *[F.col(f"`{v}`")["key"].alias(k) for v, k in zip(shared, names, strict=True)], hashed(x).alias("__h"))
    counts = lambda x, name: keyed(x).groupBy(*names).agg(F.count(F.lit(1)).alias(name))
    both = counts(a, "__pa").join(counts(b, "__pb"), names)
    parts = [F.ceil(F.col(n) / CELL).cast("int").alias(n) for n in ("__pa", "__pb")]
    hot = both.select(*names, *parts).where((F.col("__pa") > 1) | (F.col("__pb") > 1))

    def dealt(x: Solutions, own: str, other: str) -> DataFrame:
        part = F.pmod("__h", F.coalesce(F.col(own), F.lit(1))).cast("int")
        others = F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1)
        return keyed(x).join(hot, names, "left").select(*[f"`{v}`" for v in x.vars], *names, part.alias(own), F.explode(others).alias(other))

    right = dealt(b, "__pb", "__pa").select(*[F.col(f"`{v}`").alias(f"__r_{v}") for v in b.vars if v not in shared], *[F.col(n).alias(f"__r{n}") for n in (*names, "__pa", "__pb")])
    on = reduce(lambda p, q: p & q, [F.col(n) == F.col(f"__r{n}") for n in (*names, "__pa", "__pb")])
    picked = [F.col(f"`{v}`") for v in a.vars] + [F.col(f"`__r_{v}`").alias(v) for v in b.vars if v not in shared]
    # a count of partitions of its own, by the pairs: bytes of the input say nothing of them, and a fixed count
    # would give each task pairs that grow with the square of a group
    pairs = both.agg(F.sum(F.col("__pa").cast("double") * F.col("__pb"))).first()[0] or 0.0
    tasks = max(int(a.df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(math.ceil(pairs / TASK_PAIRS), MOST_TASKS))
    left = dealt(a, "__pa", "__pb").repartition(tasks, *names, "__pa", "__pb")
    out = left.join(right, on).select(*picked)
    return Solutions(out, (*a.vars, *[v for v in b.vars if v not in shared]), a.certain | b.certain)


def weighed(rows: Solutions, keep: set[str]) -> Solutions:
    """One row for rows that are equal in the variables of ``keep``; how many is a variable more."""
    names = [v for v in rows.vars if v in keep]
    if len(names) == len([v for v in rows.vars if not v.startswith(WEIGHT)]):
        return rows
    count = f"{WEIGHT}{uuid.uuid4().hex[:8]}"
    keys = [F.col(f"`{v}`")["key"].alias(f"__k{n}") for n, v in enumerate(names)]
    df = rows.df.groupBy(*keys).agg(*[F.first(f"`{v}`").alias(v) for v in names], F.sum(weight(rows)).alias(count))
    return Solutions(df.select(*[f"`{v}`" for v in names], count), (*names, count), frozenset(v for v in rows.certain if v in names) | {count})


def weight(rows: Solutions):
    """How many solutions a row stands for."""
    return reduce(lambda p, q: p * q, [F.col(v) for v in rows.vars if v.startswith(WEIGHT)], F.lit(1).cast("long"))


def union(a: Solutions, b: Solutions) -> Solutions:
    names = list(dict.fromkeys([*a.vars, *b.vars]))
    return Solutions(a.select(names).df.unionByName(b.select(names).df), tuple(names), a.certain & b.certain)


class Builder:
    """Evaluates patterns against one snapshot.

    With a ``registry``, a pattern whose bound subject or object is not of the type that its predicate
    declares has no rows, and reads none of that predicate.
    """

    def __init__(self, snapshot: Snapshot, spark, registry: Registry | None = None):
        self.snapshot, self.spark, self.registry = snapshot, spark, registry
        self.derived: dict[str, DataFrame] = {}

    # --- one pattern -------------------------------------------------------------------------

    def scan(self, p: Pattern, derived: dict[str, DataFrame] | None = None) -> Solutions:
        facts = self.derived if derived is None else derived
        name = p.p.value if isinstance(p.p, Value) else None
        if p.hops is not None:
            return self._path(p)
        if name in facts:
            if p.graph != UNION:
                return Solutions(self.spark.createDataFrame([], ", ".join(f"`{v}` {terms.TERM_DDL}" for v in p.vars()) or "x int").select(*[f"`{v}`" for v in p.vars()]), tuple(p.vars()), frozenset(p.vars()))
            rows = facts[name].select(F.lit("").alias("g"), "s", F.lit(name).alias("p"), terms.node(F.col("o")).alias("o"), F.lit(None).cast("string").alias("edge_id"))
            rows = rows.where(F.col("s") == p.s.value) if isinstance(p.s, Value) else rows
            rows = rows.where(F.col("o.key") == p.o.key()) if isinstance(p.o, Value) else rows
        else:
            rows = self.snapshot.scan(p.s, p.p, p.o, p.graph)
            for node, column, end in ((p.s, "s", "domain"), (p.o, "o.str", "range")):
                if name and self.registry and isinstance(node, Value) and node.kind == "U":
                    allowed = schema_allows(self.registry, self.snapshot, name, node.value, end)
                    rows = rows if allowed is None else rows.join(allowed, F.col(column) == F.col("__typed"), "left_semi")
        return self._bind(rows, p)

    def _bind(self, rows: DataFrame, p: Pattern) -> Solutions:
        if isinstance(p.o, Var):
            rows = rows.where(F.col("o.kind") == "U") if p.nodes_only else rows.where(F.col("o.kind") != "V")
        if p.edge:
            rows = rows.where(F.col("edge_id").isNotNull())
        slots = [(t.name, c) for t, c in ((p.s, terms.node(F.col("s"))), (p.p, terms.node(F.col("p"))), (p.o, F.col("o"))) if isinstance(t, Var)]
        slots += [(p.graph.var, terms.node(F.col("g")))] if p.graph.var else []
        slots += [(p.edge, terms.node(F.col("edge_id")))] if p.edge else []
        seen: dict[str, object] = {}
        for var, col in slots:
            if var in seen:
                rows = rows.where(seen[var]["key"] == col["key"])
            else:
                seen[var] = col
        return Solutions(rows.select(*[c.alias(v) for v, c in seen.items()]), tuple(seen), frozenset(seen))

    def _path(self, p: Pattern, among: Solutions | None = None) -> Solutions:
        """With ``among``, solutions of patterns that bind the start, a path of no edges is looked for from
        the nodes there only."""
        if not isinstance(p.p, Value):
            raise ValueError("a path needs its predicate")
        least, most = p.hops
        quads = self.snapshot.scan(p=p.p, graph=replace(p.graph, var=None)).where(F.col("o.kind") == "U")
        edges = quads.select("s", F.col("o.str").alias("o"))
        ends = [t.value if isinstance(t, Value) else None for t in (p.s, p.o)]

        def nodes() -> DataFrame:
            if among is not None:
                starts = among.df.select(F.col(f"`{p.s.name}`").alias("t"))
                return starts.where(F.col("t.kind") == "U").select(F.col("t.str").alias("n")).distinct()
            every = self.snapshot.scan(graph=p.graph)
            return every.select(F.col("s").alias("n")).unionByName(every.where(F.col("o.kind") == "U").select(F.col("o.str").alias("n"))).distinct()

        pairs = recursion.path(edges, least, most, nodes, *ends)
        full = pairs.select(F.lit("").alias("g"), "s", F.lit(p.p.value).alias("p"), terms.node(F.col("o")).alias("o"), F.lit(None).cast("string").alias("edge_id"))
        return self._bind(full, replace(p, graph=UNION, edge=None))

    # --- conjunctions ------------------------------------------------------------------------

    def conjunction(self, patterns: list[Pattern], seed: Solutions | None = None, deltas: dict[int, DataFrame] | None = None, derived: dict[str, DataFrame] | None = None, keep: set[str] | None = None) -> Solutions:
        """The natural join of patterns, with duplicates; no pattern gives one empty row.

        Patterns are taken greedily: joined to what is there before apart from it, with more bound terms
        before fewer. With ``keep``, variables outside it may be missing from the result, and equal rows may
        be one row, counted in the columns that :func:`weight` multiplies.
        """
        facts = self.derived if derived is None else derived
        out = seed
        left = list(range(len(patterns)))
        unique = None  # the variable that no two rows of ``out`` share, where a subject has one value each
        while left:
            known = set(out.vars) if out else set()

            def rank(k: int) -> tuple:
                p = patterns[k]
                apart = bool(known) and not known & set(p.vars())
                bound = sum(isinstance(t, Value) or (isinstance(t, Var) and t.name in known) for t in (p.s, p.p, p.o))
                fixed = sum(isinstance(t, Value) for t in (p.s, p.o))
                away = isinstance(p.s, Var) and p.s.name not in known
                return apart, p.hops is not None, -bound, -fixed, away, k

            k = min(left, key=rank)
            take, rows = self._unit(k, left, patterns, known, facts, deltas or {})
            left = [n for n in left if n not in take]
            if rows is None:
                p = patterns[k]
                rows = self.scan(p, {**facts, p.p.value: deltas[k]} if deltas and k in deltas else facts)
            subject = patterns[k].s.name if isinstance(patterns[k].s, Var) and patterns[k].hops is None else None
            shared = known & set(rows.vars)
            if out is None:
                out, unique = rows, subject
            elif not shared or subject in shared or unique in shared:
                out, unique = join(out, rows), unique if subject in shared else subject if shared else None
            else:  # neither side has one row a key
                if keep is not None:
                    later = keep | {v for n in left for v in patterns[n].vars()} | shared
                    out, rows = weighed(out, later), weighed(rows, later)
                out, unique = spread_join(out, rows), None
        return out or one_row(self.spark)

    def _unit(self, k: int, left: list[int], patterns: list[Pattern], known: set[str], facts: dict, deltas: dict) -> tuple[list[int], Solutions | None]:
        """Patterns to be taken together with pattern ``k``, and their solutions (None: it goes alone).

        Patterns of one subject are one scan where rows of a table hold them. Elsewhere they are joined to
        each other first if more than one of their variables is known: a join on the first alone could
        have far more rows than all of them leave.
        """
        p = patterns[k]
        plain = lambda n: isinstance(patterns[n].p, Value) and patterns[n].p.kind == "U" and patterns[n].hops is None and patterns[n].edge is None and n not in deltas and patterns[n].p.value not in facts
        if not isinstance(p.s, Var) or not plain(k):
            return [k], None
        star = [n for n in left if n == k or (patterns[n].s == p.s and plain(n))]
        if len(star) == 1:
            return star, None
        mine = [patterns[n] for n in star]
        if self.registry is None and self.snapshot.rows is not None and self.snapshot.readable is None and all(q.graph == UNION for q in mine):
            kinds = [q.o.value for q in mine if q.p.value == RDF_TYPE and isinstance(q.o, Value) and q.o.kind == "U"]
            rows = self.snapshot.rows([q.p.value for q in mine], kinds[0] if kinds else None)
            if rows is not None:
                return star, self._bind_star(rows, mine)
        linked = {q.o.name for q in mine if isinstance(q.o, Var) and q.o.name in known}
        if p.s.name in known or len(linked) < 2:
            return [k], None
        return star, reduce(join, [self.scan(q, facts) for q in mine])

    def _bind_star(self, rows: DataFrame, patterns: list[Pattern]) -> Solutions:
        seen: dict[str, object] = {patterns[0].s.name: terms.node(F.col("s"))}
        for n, p in enumerate(patterns):
            o = F.col(f"o{n}")
            if isinstance(p.o, Value):
                rows = rows.where(o["key"] == p.o.key())
                continue
            rows = rows.where(o["kind"] == "U") if p.nodes_only else rows.where(o["kind"] != "V")
            if p.o.name in seen:
                rows = rows.where(seen[p.o.name]["key"] == o["key"])
            else:
                seen[p.o.name] = o
        return Solutions(rows.select(*[c.alias(v) for v, c in seen.items()]), tuple(seen), frozenset(seen))

    def query(self, query: Query, seed: Solutions | None = None) -> Solutions:
        if query.rules:
            self.derived = self.rules(query.rules)
        return self.conjunction(query.patterns, seed)

    def rules(self, rules: list[Rule]) -> dict[str, DataFrame]:
        """Facts ``(s, o)`` of the rules' heads, to the fixpoint."""
        heads = {r.head for r in rules}
        scratch = Scratch(self.spark, "rules")
        uses = lambda r: [k for k, p in enumerate(r.body) if isinstance(p.p, Value) and p.p.value in heads]

        def facts(rule: Rule, deltas: dict[int, DataFrame], known: dict[str, DataFrame]) -> DataFrame:
            rows = self.conjunction(list(rule.body), deltas=deltas, derived=known).df
            s, o = F.col(f"`{rule.s}`"), F.col(f"`{rule.o}`")
            return rows.where((s["kind"] == "U") & (o["kind"] == "U")).select(s["str"].alias("s"), o["str"].alias("o"))

        def base():
            out: dict[str, list[DataFrame]] = {}
            for r in rules:
                if not uses(r):
                    out.setdefault(r.head, []).append(facts(r, {}, {}))
            return out

        def step(known, new):
            out: dict[str, list[DataFrame]] = {}
            for r in rules:
                for k in uses(r):
                    if (name := r.body[k].p.value) in new:
                        out.setdefault(r.head, []).append(facts(r, {k: new[name]}, known))
            return out

        # heads that no rule looks at are found once, from what the rounds found
        used = {p.p.value for r in rules for p in r.body if isinstance(p.p, Value)}
        every, rules = rules, [r for r in rules if r.head in used]
        heads, last = {r.head for r in rules}, [r for r in every if r.head not in used]
        known = recursion.fixpoint(scratch, heads, base, step) if rules else {}
        found: dict[str, list[DataFrame]] = {}
        for r in last:
            found.setdefault(r.head, []).append(facts(r, {}, known))
        return known | {head: scratch.save(reduce(DataFrame.unionByName, rows).distinct(), f"last-{n}") for n, (head, rows) in enumerate(sorted(found.items()))}


def explain(patterns: list[Pattern], rules: list[Rule] = ()) -> list[dict]:
    """Static steps: which terms are bound at each pattern, what that reads, which variables are new."""
    index = {0: "all", 1: "o", 2: "p", 3: "po", 4: "s", 5: "so", 6: "sp", 7: "spo"}
    heads, known, out = {r.head for r in rules}, set(), []
    for n, p in enumerate(patterns):
        bound = [isinstance(t, Value) or (isinstance(t, Var) and t.name in known) for t in (p.s, p.p, p.o)]
        fresh = [v for v in p.vars() if v not in known]
        recursive = p.hops is not None or (isinstance(p.p, Value) and p.p.value in heads)
        out.append({"step": n, "reads": "derived" if recursive and p.hops is None else index[bound[0] * 4 + bound[1] * 2 + bound[2]], "binds": fresh, "recursive": recursive})
        known |= set(fresh)
    return out
