"""OWL 2 RL inference: twelve rules to a fixpoint, whole or by changes.

A fact is ``(label, s, p, o)``; the label is the graph it follows from, or ``cross`` where premises are
of several graphs. What the schema says (sub-classes, sub-properties, domains, ranges, inverses,
symmetric and transitive properties) is taken out first and closed; schema facts are no instance
premises. All rules with one instance premise are joins with one small rule table each.

A schema of up to SMALL rules, by count, is closed on the driver over all its rules at once: each
predicate then has all that follows from one of its facts, through any chain of rules, in one table. So
a single join gives all consequences of a fact, and rounds are needed for transitive properties only.
Larger schemas are closed by the same rules in rounds, distributed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadspark.functions import terms
from quadspark.functions.terms import OWL, RDF_TYPE, RDFS
from quadspark.operators.snapshot import INFERRED
from quadspark.scratch import Scratch

CROSS = "cross"
SUBCLASS, SUBPROP, DOMAIN, RANGE = (RDFS + n for n in ("subClassOf", "subPropertyOf", "domain", "range"))
INVERSE, SAME = OWL + "inverseOf", OWL + "sameAs"
SYMMETRIC, TRANSITIVE = OWL + "SymmetricProperty", OWL + "TransitiveProperty"
SCHEMA = (SUBCLASS, SUBPROP, DOMAIN, RANGE, INVERSE)
KEYS = ["label", "s", "p", "k"]
SMALL = 20_000
CHAIN_DDL = "p string, rl string, q string, class string, flip boolean, node boolean, end string"


def _both(a: Column, b: Column) -> Column:
    return F.when(a == b, a).otherwise(F.lit(CROSS))


def _facts(quads: DataFrame) -> DataFrame:
    return quads.select(F.col("g").alias("label"), "s", "p", "o", F.col("o.key").alias("k"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _closed(pairs: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Transitive closure of ``(label, a, b)`` with labels combined."""
    known = scratch.save(pairs.distinct(), f"{name}-0")
    parts, turn = [known], 0
    delta = known
    while not delta.isEmpty():
        step = known.select(F.col("label").alias("l2"), F.col("a").alias("b"), F.col("b").alias("c"))
        new = delta.join(step, "b").select(_both(F.col("label"), F.col("l2")).alias("label"), "a", F.col("c").alias("b")).where("a <> b").distinct()
        turn += 1
        delta = scratch.save(new.join(_union(parts), ["label", "a", "b"], "left_anti"), f"{name}-{turn}")
        parts.append(delta)
    return _union(parts)


@dataclass
class Schema:
    """Closed tables: classes (a below b), rewrites (p to q, perhaps flipped), ends (p gives a class), transitive p."""

    classes: DataFrame
    rewrites: DataFrame
    ends: DataFrame
    transitive: DataFrame
    derived: DataFrame  # schema facts that the closures add


def schema(quads: DataFrame, scratch: Scratch, graphs: list[str] | None = None) -> Schema:
    """``graphs`` limits where schema facts are taken from."""
    facts = _facts(quads).where(F.col("o.kind") == "U")
    facts = facts if graphs is None else facts.where(F.col("label").isin(*graphs))
    pairs = lambda p: facts.where(F.col("p") == p).select("label", F.col("s").alias("a"), F.col("o.str").alias("b"))
    marked = lambda c: facts.where((F.col("p") == RDF_TYPE) & (F.col("o.str") == c)).select("label", F.col("s").alias("a"))
    sub, prop = _closed(pairs(SUBCLASS), scratch, "classes"), _closed(pairs(SUBPROP), scratch, "properties")
    inverse = pairs(INVERSE)
    forward = lambda df, flip: df.select("label", F.col("a").alias("p"), F.col("b").alias("q"), F.lit(flip).alias("flip"))
    back = inverse.select("label", F.col("b").alias("a"), F.col("a").alias("b"))
    symmetric = marked(SYMMETRIC).withColumn("b", F.col("a"))
    same = quads.sparkSession.createDataFrame([(None, SAME, SAME, True)], "label string, p string, q string, flip boolean")
    rewrites = _union([forward(prop, False), forward(inverse, True), forward(back, True), forward(symmetric, True), same]).distinct()
    end = lambda p, of: pairs(p).select("label", F.col("a").alias("p"), F.col("b").alias("class"), F.lit(of).alias("end"))
    ends = end(DOMAIN, "s").unionByName(end(RANGE, "o")).distinct()
    same_as = quads.sparkSession.createDataFrame([(None, SAME)], "label string, p string")
    transitive = marked(TRANSITIVE).select("label", F.col("a").alias("p")).unionByName(same_as).distinct()
    as_fact = lambda df, p: df.select("label", F.col("a").alias("s"), F.lit(p).alias("p"), terms.node(F.col("b")).alias("o")).withColumn("k", F.col("o.key"))
    derived = as_fact(sub, SUBCLASS).unionByName(as_fact(prop, SUBPROP)).join(facts.select(*KEYS), KEYS, "left_anti")
    saved = {n: scratch.save(df, n) for n, df in {"rules-c": sub, "rules-r": rewrites, "rules-e": ends, "rules-t": transitive, "rules-d": derived}.items()}
    return Schema(*saved.values())


def consequences(new: DataFrame, known: DataFrame, rules: Schema) -> DataFrame:
    """Facts that follow in one step with at least one premise of ``new``; ``known`` holds ``new`` too."""
    label = lambda other: F.when(F.col(other).isNull(), F.col("label")).otherwise(_both(F.col("label"), F.col(other)))
    node = F.col("o.kind") == "U"
    shape = lambda df, l, s, p, o: df.select(l.alias("label"), s.alias("s"), p.alias("p"), o.alias("o"))
    r = rules.rewrites.select(F.col("label").alias("rl"), "p", "q", "flip")
    hit = new.join(r, "p").where(~F.col("flip") | node)
    moved = shape(hit, label("rl"), F.when(F.col("flip"), F.col("o.str")).otherwise(F.col("s")), F.col("q"), F.when(F.col("flip"), terms.node(F.col("s"))).otherwise(F.col("o")))
    e = rules.ends.select(F.col("label").alias("rl"), "p", "class", "end")
    hit = new.join(e, "p").where((F.col("end") == "s") | node)
    typed = shape(hit, label("rl"), F.when(F.col("end") == "s", F.col("s")).otherwise(F.col("o.str")), F.lit(RDF_TYPE), terms.node(F.col("class")))
    c = rules.classes.select(F.col("label").alias("rl"), F.concat(F.lit("U:"), F.col("a")).alias("k"), F.col("b").alias("up"))
    hit = new.where(F.col("p") == RDF_TYPE).join(c, "k")
    raised = shape(hit, label("rl"), F.col("s"), F.col("p"), terms.node(F.col("up")))
    t = rules.transitive.select(F.col("label").alias("rl"), "p")
    left = new.where(node).join(t, "p").select("p", label("rl").alias("label"), "s", F.col("o.str").alias("mid"))
    # only facts of transitive properties can be a second premise
    known = known.join(t.select("p").distinct(), "p", "left_semi").select("label", "s", "p", "o")
    right = known.select(F.col("p"), F.col("label").alias("l2"), F.col("s").alias("mid"), "o")
    ahead = shape(left.join(right, ["p", "mid"]), _both(F.col("label"), F.col("l2")), F.col("s"), F.col("p"), F.col("o"))
    right = new.join(t, "p").select("p", label("rl").alias("label"), F.col("s").alias("mid"), "o")
    left = known.where(F.col("o.kind") == "U").select("p", F.col("label").alias("l2"), "s", F.col("o.str").alias("mid"))
    behind = shape(left.join(right, ["p", "mid"]), _both(F.col("label"), F.col("l2")), F.col("s"), F.col("p"), F.col("o"))
    out = _union([moved, typed, raised, ahead, behind]).withColumn("k", F.col("o.key"))
    # a node is trivially the same as itself
    return out.where((F.col("p") != SAME) | (F.concat(F.lit("U:"), F.col("s")) != F.col("k"))).dropDuplicates(KEYS)


#: Facts that follow from new ones in a step; the known ones hold them too.
Step = Callable[[DataFrame, DataFrame], DataFrame]


def _fixpoint(start: DataFrame, known: list[DataFrame], step: Step, scratch: Scratch, name: str) -> list[DataFrame]:
    """Facts that follow from ``start``, which is part of ``known``, and are not in it; one frame a round."""
    out: list[DataFrame] = []
    delta, turn = start, 0
    while not delta.isEmpty():
        every = _union([*known, *out])
        found = step(delta, every).join(every.select(*KEYS), KEYS, "left_anti")
        delta = scratch.save(found, f"{name}-{turn}")
        out.append(delta)
        turn += 1
    return out


def _instance(facts: DataFrame) -> DataFrame:
    return facts.where(~F.col("p").isin(*SCHEMA) & ~((F.col("p") == RDF_TYPE) & F.col("k").isin(f"U:{SYMMETRIC}", f"U:{TRANSITIVE}")))


def is_schema() -> Column:
    """Whether a quad says something about classes or properties."""
    marks = F.col("o.key").isin(f"U:{SYMMETRIC}", f"U:{TRANSITIVE}")
    return F.col("p").isin(*SCHEMA) | ((F.col("p") == RDF_TYPE) & marks)


@dataclass
class Chains:
    """A small schema in closed form: what follows from one fact of a predicate, through any chain of rules."""

    rows: list[tuple]  # (p, label, q, class, flip, node, end): a rewrite to q, or a class of one end
    classes: list[tuple]  # (label, class, class above)
    transitive: list[tuple]  # (p, label)
    derived: list[tuple]  # (label, s, p, o) that the closures add


def _mix(*labels: str | None) -> str | None:
    own = {x for x in labels if x is not None}
    return None if not own else own.pop() if len(own) == 1 else CROSS


def _reach(start: set[tuple], step) -> set[tuple]:
    """Everything that steps lead to."""
    seen, work = set(start), list(start)
    while work:
        for item in step(work.pop()):
            if item not in seen:
                seen.add(item)
                work.append(item)
    return seen


def chains(facts: list[tuple]) -> Chains | None:
    """The closed form of schema facts ``(label, s, p, o)``; None if rules are about rdf:type or the
    schema's own predicates, which only rounds follow."""
    by: dict[str, list[tuple]] = {}
    for label, s, p, o in facts:
        by.setdefault(o if p == RDF_TYPE else p, []).append((label, s, o))
    special = {RDF_TYPE, *SCHEMA}
    if any(special & {s, o} for p in (SUBPROP, INVERSE, DOMAIN, RANGE, SYMMETRIC, TRANSITIVE) for _, s, o in by.get(p, ())):
        return None

    def closed(p: str) -> set[tuple]:
        up: dict[str, list] = {}
        for label, s, o in by.get(p, ()):
            up.setdefault(s, []).append((label, o))
        pairs = {(label, s, o) for label, s, o in by.get(p, ())}
        return {x for x in _reach(pairs, lambda x: [(_mix(x[0], label), x[1], o) for label, o in up.get(x[2], ()) if o != x[1]])}

    classes, properties = closed(SUBCLASS), closed(SUBPROP)
    moves: dict[str, set[tuple]] = {}
    for label, s, o in by.get(SUBPROP, ()):
        moves.setdefault(s, set()).add((label, o, False))
    for label, s, o in by.get(INVERSE, ()):
        moves.setdefault(s, set()).add((label, o, True))
        moves.setdefault(o, set()).add((label, s, True))
    for label, s, _ in by.get(SYMMETRIC, ()):
        moves.setdefault(s, set()).add((label, s, True))
    moves.setdefault(SAME, set()).add((None, SAME, True))
    ends: dict[str, set[tuple]] = {}
    for p, end in ((DOMAIN, "s"), (RANGE, "o")):
        for label, s, o in by.get(p, ()):
            ends.setdefault(s, set()).add((label, o, end))
    above: dict[str, set[tuple]] = {}
    for label, s, o in classes:
        above.setdefault(s, set()).add((label, o))
    rows: set[tuple] = set()
    for start in {*moves, *ends}:
        # (label, predicate, flipped, by way of a flip)
        reached = _reach({(None, start, False, False)}, lambda x: [(_mix(x[0], label), q, x[2] != flip, x[3] or flip) for label, q, flip in moves.get(x[1], ())])
        for label, q, flip, node in reached:
            if (label, q, flip) != (None, start, False):
                rows.add((start, label, q, None, flip, node, None))
            for l2, c, end in ends.get(q, ()):
                own = end if not flip else "o" if end == "s" else "s"
                first = (_mix(label, l2), c)
                for l3, c3 in {first, *[(_mix(first[0], l4), up) for l4, up in above.get(c, ())]}:
                    rows.add((start, l3, None, c3, False, node or own == "o", own))
    asserted = set(facts)
    derived = [(label, s, p, o) for p, pairs in ((SUBCLASS, classes), (SUBPROP, properties)) for label, s, o in pairs if (label, s, p, o) not in asserted]
    transitive = [(s, label) for label, s, _ in by.get(TRANSITIVE, ())] + [(SAME, None)]
    order = lambda x: tuple("" if v is None else str(v) for v in x)
    return Chains(sorted(rows, key=order), sorted(classes), sorted(set(transitive), key=order), sorted(derived))


def _small_schema(quads: DataFrame, graphs: list[str] | None) -> Chains | None:
    facts = quads.where(is_schema() & (F.col("o.kind") == "U"))
    facts = facts if graphs is None else facts.where(F.col("g").isin(*graphs))
    got = facts.select("g", "s", "p", F.col("o.str").alias("o")).distinct().limit(SMALL + 1).collect()
    return chains([tuple(r) for r in got]) if len(got) <= SMALL else None


def _followed(new: DataFrame, rules: DataFrame, classes: DataFrame) -> DataFrame:
    """All facts that follow from each fact alone: one join by predicate, one by class."""
    label = F.when(F.col("rl").isNull(), F.col("label")).otherwise(_both(F.col("label"), F.col("rl")))
    hit = new.join(rules, "p").where(~F.col("node") | (F.col("o.kind") == "U"))
    typed = F.col("class").isNotNull()
    subject = F.when(F.col("flip") | (F.col("end") == "o"), F.col("o.str")).otherwise(F.col("s"))
    value = F.when(typed, terms.node(F.col("class"))).when(F.col("flip"), terms.node(F.col("s"))).otherwise(F.col("o"))
    moved = hit.select(label.alias("label"), subject.alias("s"), F.when(typed, F.lit(RDF_TYPE)).otherwise(F.col("q")).alias("p"), value.alias("o"))
    raised = new.where(F.col("p") == RDF_TYPE).join(classes, "k").select(label.alias("label"), "s", "p", terms.node(F.col("up")).alias("o"))
    out = moved.unionByName(raised).withColumn("k", F.col("o.key"))
    return out.where((F.col("p") != SAME) | (F.concat(F.lit("U:"), F.col("s")) != F.col("k")))


def _tables(spark, found: Chains) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Rules by predicate, classes above by class, transitive predicates, and facts that the closures add."""
    classes = spark.createDataFrame(found.classes, "rl string, c string, up string").select("rl", F.concat(F.lit("U:"), F.col("c")).alias("k"), "up")
    derived = spark.createDataFrame(found.derived, "label string, s string, p string, v string").select("label", "s", "p", terms.node(F.col("v")).alias("o")).withColumn("k", F.col("o.key"))
    return spark.createDataFrame(found.rows, CHAIN_DDL), classes, spark.createDataFrame(found.transitive, "p string, rl string"), derived


def _stepper(quads: DataFrame, scratch: Scratch) -> tuple[Step, DataFrame]:
    """The step under the schema of the quads, and the schema facts that its closure adds."""
    found = _small_schema(quads, None)
    if found is None:
        rules = schema(quads, scratch)
        return lambda new, known: consequences(new, known, rules), rules.derived
    rules, classes, transitive, derived = _tables(quads.sparkSession, found)

    def step(new: DataFrame, known: DataFrame) -> DataFrame:
        pairs = lambda df, end: df.where(F.col("o.kind") == "U").join(transitive, "p").select("p", F.when(F.col("rl").isNull(), F.col("label")).otherwise(_both(F.col("label"), F.col("rl"))).alias("label"), F.col("s").alias("s" if end else "mid"), F.col("o.str").alias("mid" if end else "n"))
        through = [pairs(a, True).join(pairs(b, False).withColumnRenamed("label", "l2"), ["p", "mid"]) for a, b in ((new, known), (known, new))]
        longer = _union(through).select(_both(F.col("label"), F.col("l2")).alias("label"), "s", "p", terms.node(F.col("n")).alias("o")).withColumn("k", F.col("o.key"))
        longer = longer.where((F.col("p") != SAME) | (F.concat(F.lit("U:"), F.col("s")) != F.col("k")))
        return _followed(new, rules, classes).unionByName(longer).dropDuplicates(KEYS)

    return step, derived


def _materialize_small(base: DataFrame, asserted: DataFrame, found: Chains, scratch: Scratch) -> DataFrame:
    """Facts ``(label, s, p, o, k)`` that follow from asserted ones under a small schema."""
    rules, classes, transitive, derived = _tables(base.sparkSession, found)
    firsts = scratch.save(_followed(asserted, rules, classes).dropDuplicates(KEYS).join(asserted.select(*KEYS), KEYS, "left_anti"), "first")
    out, known = [firsts], [asserted, firsts]
    edges = lambda df: df.where(F.col("o.kind") == "U").join(transitive, "p").select("p", F.when(F.col("rl").isNull(), F.col("label")).otherwise(_both(F.col("label"), F.col("rl"))).alias("label"), "s", F.col("o.str").alias("n"))
    delta, turn = scratch.save(edges(_union(known)).distinct(), "edges"), 0
    pairs = [delta]
    while not delta.isEmpty():
        # pairs at up to twice the distance: the newest joined to all known, on either side as what follows
        # from a pair may be an edge of another property, then what follows from them
        every = _union(pairs)
        join = lambda a, b: a.join(b.select("p", F.col("label").alias("l2"), F.col("s").alias("n"), F.col("n").alias("end")), ["p", "n"]).select("p", _both(F.col("label"), F.col("l2")).alias("label"), "s", F.col("end").alias("n"))
        longer = join(delta, every).unionByName(join(every, delta)).distinct()
        turn += 1
        longer = longer.where((F.col("p") != SAME) | (F.col("s") != F.col("n"))).join(every, ["p", "label", "s", "n"], "left_anti")
        facts = longer.select("label", "s", "p", terms.node(F.col("n")).alias("o")).withColumn("k", F.col("o.key"))
        more = scratch.save(facts.unionByName(_followed(facts, rules, classes)).dropDuplicates(KEYS).join(_union(known).select(*KEYS), KEYS, "left_anti"), f"more-{turn}")
        out.append(more)
        known.append(more)
        delta = scratch.save(edges(more).distinct().join(every, ["p", "label", "s", "n"], "left_anti"), f"edges-{turn}")
        pairs.append(delta)
    return _union([*out, derived])


def materialize(quads: DataFrame, schema_graphs: list[str] | None = None) -> DataFrame:
    """Inferred quads ``(g, s, p, o)`` in companion graphs, without what is asserted in any graph of the same label."""
    scratch = Scratch(quads.sparkSession, "owl")
    base = quads.where(~F.col("g").startswith(INFERRED))
    asserted = scratch.save(_instance(_facts(base)).dropDuplicates(KEYS), "asserted")
    small = _small_schema(base, schema_graphs)
    if small is not None:
        inferred = _materialize_small(base, asserted, small, scratch)
    else:
        rules = schema(base, scratch, schema_graphs)
        step = lambda new, known: consequences(new, known, rules)
        inferred = _union([*_fixpoint(asserted, [asserted], step, scratch, "facts"), rules.derived])
    # a fact that one graph asserts is not inferred again across graphs
    crossing = asserted.select(F.lit(CROSS).alias("label"), "s", "p", "k").distinct()
    kept = inferred.join(crossing, KEYS, "left_anti").dropDuplicates(KEYS)
    return kept.select(F.concat(F.lit(INFERRED), "label").alias("g"), "s", "p", "o")


def difference(inferred: DataFrame, live: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Quads to assert and to close, so that the live inferred ones become ``inferred``."""
    keyed = lambda df: df.select("g", "s", "p", "o", F.col("o.key").alias("k"))
    want, have = keyed(inferred), keyed(live.where(F.col("g").startswith(INFERRED)))
    on = ["g", "s", "p", "k"]
    return want.join(have, on, "left_anti").drop("k"), have.join(want, on, "left_anti").drop("k")


def incremental(asserted: DataFrame, inferred: DataFrame, added: DataFrame, deleted: DataFrame) -> DataFrame:
    """The inferred quads after changes, by delete and re-derive.

    ``asserted`` is before the changes. What follows from deleted facts is taken out, what of it still
    follows from the rest is put back, and additions are followed up. Changes of the schema need
    :func:`materialize` instead.
    """
    scratch = Scratch(asserted.sparkSession, "dred")
    step, derived = _stepper(asserted, scratch)
    before = scratch.save(_instance(_facts(asserted)).dropDuplicates(KEYS), "before")
    old = scratch.save(_instance(_facts(inferred).withColumn("label", F.substring("label", len(INFERRED) + 1, 1 << 20))).dropDuplicates(KEYS), "old")
    gone = scratch.save(_instance(_facts(deleted)).dropDuplicates(KEYS), "gone")
    more = scratch.save(_instance(_facts(added)).dropDuplicates(KEYS), "more")
    every = before.unionByName(old)
    over, delta, turn = [], gone, 0
    while not delta.isEmpty():
        hit = step(delta, every).select(*KEYS).join(old, KEYS, "left_semi")
        hit = hit if not over else hit.join(_union(over).select(*KEYS), KEYS, "left_anti")
        delta = scratch.save(old.join(hit, KEYS, "left_semi"), f"over-{turn}")
        over.append(delta)
        turn += 1
    lost = _union(over) if over else old.where(F.lit(False))
    kept = old.join(lost.select(*KEYS), KEYS, "left_anti")
    base = before.join(gone.select(*KEYS), KEYS, "left_anti").unionByName(more).dropDuplicates(KEYS)
    rest = scratch.save(base.unionByName(kept).dropDuplicates(KEYS), "rest")
    # a premise of a fact shares a node with it, so only facts about nodes of lost ones are looked at again
    ends = lambda df: df.select(F.explode(F.array_compact(F.array("s", F.when(F.col("o.kind") == "U", F.col("o.str"))))).alias("n"))
    # what was asserted and goes may follow from the rest, under any label
    out = old.join(lost.select(*KEYS), KEYS, "left_semi").unionByName(gone)
    target = scratch.save(out.select("s", "p", "k").distinct(), "target")
    nodes = scratch.save(ends(out).distinct(), "nodes")
    by_s, by_o = rest.join(nodes, F.col("s") == F.col("n"), "left_semi"), rest.join(nodes, F.col("o.str") == F.col("n"), "left_semi").where(F.col("o.kind") == "U")
    near = scratch.save(by_s.unionByName(by_o).dropDuplicates(KEYS), "near")
    again = scratch.save(step(near, near).join(target, ["s", "p", "k"], "left_semi").join(rest.select(*KEYS), KEYS, "left_anti"), "again")
    start = scratch.save(again.unionByName(more).dropDuplicates(KEYS), "start")
    found = _fixpoint(start, [rest, again], step, scratch, "new")
    out = _union([kept, again, *found, derived])
    out = out.join(base.select(*KEYS), KEYS, "left_anti").join(base.select("s", "p", "k").distinct().withColumn("label", F.lit(CROSS)), KEYS, "left_anti").dropDuplicates(KEYS)
    return out.select(F.concat(F.lit(INFERRED), "label").alias("g"), "s", "p", "o")
