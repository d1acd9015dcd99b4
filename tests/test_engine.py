"""The engine on tiny graphs: semantics that tables do not show."""

import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from quadspark.engine import DeadlineExceeded, Engine, Malformed
from quadspark.functions import terms
from quadspark.functions.terms import OWL, RDF_TYPE, RDFS, XSD, Value, parse_literal
from quadspark.operators import owl, recursion, snapshot
from quadspark.operators.ontology import EdgeType, Field, NodeType, Registry
from quadspark.operators.snapshot import END, QUAD_DDL, Snapshot
from quadspark.operators.store import Conflict, Expired, Store
from quadspark.plans.build import Builder, Solutions, explain, join
from quadspark.plans.cypher import java_pattern
from quadspark.plans.cypher import parse as parse_cypher
from quadspark.plans.patterns import ANY, Graph, Pattern, Var, Vocabulary, parse_pattern
from quadspark.plans.sparql import Sparql
from quadspark.scratch import scratch_root
from quadspark.sources import rdf
from quadspark.streaming import changes

U = lambda x: Value("U", x)
V = "urn:v:"


@pytest.fixture
def engine(spark, tmp_path):
    times = itertools.count(100, 100)
    return Engine(spark, Store(spark, str(tmp_path / "store"), lambda: next(times)), Vocabulary(V, {"v": V}))


def plain(result):
    return sorted(tuple(r) for r in result.plain().collect())


def test_terms_parse_and_compare(spark):
    cases = [("1", None, XSD + "integer", "I"), ("thirty", None, XSD + "integer", "T"), ("1.5", None, XSD + "decimal", "D"), ("true", None, XSD + "boolean", "B"), ("x", "en", None, "L"), ("2026-09-29", None, XSD + "date", "T"), ("x", None, None, "S")]
    df = spark.createDataFrame([c[:3] for c in cases], "lex string, lang string, dt string")
    got = [r[0] for r in df.select(terms.literal(F.col("lex"), F.col("lang"), F.col("dt"))["kind"]).collect()]
    assert got == [c[3] for c in cases]
    assert [parse_literal(*c[:3]).kind for c in cases] == got
    one = spark.range(1)
    eq = lambda a, b: one.select(terms.equal(a.column(), b.column())).first()[0]
    assert eq(Value("I", 1), Value("D", 1.0)) is True
    assert eq(U("a"), Value("S", "a")) is False
    assert eq(Value("L", "a", "EN"), Value("L", "a", "en")) is True
    assert eq(Value("B", True), Value("I", 1)) is None
    less = lambda a, b: one.select(terms.less(a.column(), b.column())).first()[0]
    assert less(Value("I", 1), Value("D", 1.5)) is True
    assert less(Value("S", "a"), Value("I", 1)) is None


def test_constant_keys_equal_column_keys(spark):
    for v in (U("a"), Value("S", "x"), Value("I", -3), Value("D", 2.5), Value("B", True), Value("L", "x", "En"), Value("T", "2020-01-01", XSD + "date")):
        a, b = spark.range(1).select(v.key(), v.column()["key"]).first()
        assert a == b


def versions(spark, rows):
    return spark.createDataFrame([(g, s, "p", v, a, b, t) for g, s, v, a, b, t in rows], "g string, s string, p string, v string, vt_start bigint, vt_end bigint, tt bigint").select(
        "g", "s", "p", terms.text(F.col("v")).alias("o"), F.lit(None).cast("string").alias("edge_id"), "vt_start", "vt_end", "tt"
    )


def live(v, **at):
    return sorted((r.s, r.o.str) for r in snapshot.resolve(v, **at).collect())


def test_version_resolution(spark):
    windows = versions(spark, [("", "a", "x", 100, 200, 1), ("", "a", "x", 200, END, 2)])
    assert live(windows, vt=150) == live(windows, vt=250) == [("a", "x")]
    deleted = versions(spark, [("", "a", "x", 0, END, 10), ("", "a", "x", 0, 50, 20)])
    assert live(deleted, vt=40) and not live(deleted, vt=60) and live(deleted, vt=60, tt=15)
    future = versions(spark, [("", "a", "x", 1000, END, 1)])
    assert not live(future, vt=500)
    replaced = versions(spark, [("", "a", "A", 0, END, 10), ("", "a", "A", 0, 5, 20), ("", "a", "B", 5, END, 20)])
    assert live(replaced) == [("a", "B")]
    assert [r.o.str for r in snapshot.history(replaced, "a", "p").collect()] == ["B", "A"]
    corrected = versions(spark, [("", "a", "x", 0, END, 10), ("", "a", "x", 0, END, 20)])
    assert [r.tt for r in snapshot.retain(corrected, tx_cutoff=100).collect()] == [20]
    assert QUAD_DDL.startswith("g string")


def test_closure_against_brute_force(spark):
    rng = random.Random(4)
    edges = {(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}") for _ in range(18)}
    want = set(edges)
    while more := {(a, d) for a, b in want for c, d in edges if b == c} - want:
        want |= more
    df = spark.createDataFrame(sorted(edges), "s string, o string")
    assert {tuple(r) for r in recursion.closure(df).collect()} == want
    two = {(a, d) for a, b in edges for c, d in edges if b == c}
    assert {tuple(r) for r in recursion.bounded(df, 2, 2).collect()} == two
    assert {tuple(r) for r in recursion.path(df, 1, None, lambda: None, end="n3").collect()} == {p for p in want if p[1] == "n3"}


def test_joins_against_brute_force(spark):
    rng = random.Random(9)
    facts = sorted({(f"n{rng.randrange(6)}", rng.choice("pq"), f"n{rng.randrange(6)}") for _ in range(25)})
    snap = Snapshot.of(rdf.quads_of(spark, [("", s, p, U(o)) for s, p, o in facts]))
    pats = [Pattern(Var("x"), U("p"), Var("y")), Pattern(Var("y"), Var("r"), Var("z")), Pattern(Var("z"), U("q"), ANY)]
    got = sorted(tuple(r[v].str for v in ("x", "y", "r", "z")) for r in Builder(snap, spark).conjunction(pats).df.collect())
    want = sorted((a[0], a[2], b[1], b[2]) for a in facts if a[1] == "p" for b in facts if b[0] == a[2] for c in facts if c[1] == "q" and c[0] == b[2])
    assert got == want
    assert Builder(snap, spark).conjunction([]).df.count() == 1


def test_empty_and_unknown(engine):
    assert plain(engine.sparql("SELECT ?s { ?s v:p ?o }")) == []
    assert engine.sparql("ASK { ?s ?p ?o }").answer is False
    assert engine.cypher("MATCH (a:Person) RETURN count(*) AS n").collect()[0].n == 0


def test_sparql_three_valued_logic(engine):
    engine.insert([("", "a", V + "n", Value.of(5)), ("", "b", V + "n", Value.of("five")), ("", "c", V + "m", Value.of(1))])
    assert plain(engine.sparql("SELECT ?s { ?s v:n ?x FILTER(?x > 3 || ?x = 'five') }")) == [("a",), ("b",)]
    assert plain(engine.sparql("SELECT ?s { ?s v:n ?x FILTER(!(?x > 3)) }")) == []
    assert plain(engine.sparql("SELECT ?s ?y { ?s ?p ?x OPTIONAL { ?s v:m ?y } FILTER(BOUND(?y)) }")) == [("c", "1")]
    assert plain(engine.sparql("SELECT (SUM(?x) AS ?t) { ?s v:n ?x }")) == [(None,)]
    assert plain(engine.sparql("SELECT ?z { VALUES (?s ?z) { (<a> 1) (UNDEF 2) } ?s v:n 5 }")) == [("1",), ("2",)]
    assert plain(engine.sparql("SELECT ?l { <a> v:n ?x BIND(IF(?x > 3, 'big', 'small') AS ?l) }")) == [("big",)]


def test_graphs_and_datasets(engine):
    engine.insert([("g1", "a", V + "p", U("b")), ("g2", "a", V + "p", U("b")), ("", "c", V + "p", U("d"))])
    assert plain(engine.sparql("SELECT ?s ?o { ?s v:p ?o }")) == [("a", "b"), ("c", "d")]
    assert plain(engine.sparql("SELECT ?g { GRAPH ?g { ?s v:p ?o } }")) == [("g1",), ("g2",)]
    assert plain(engine.sparql("SELECT ?s FROM <g1> FROM <g2> { ?s v:p ?o }")) == [("a",)]
    assert plain(engine.sparql("SELECT ?g FROM NAMED <g1> { GRAPH ?g { ?s v:p ?o } }")) == [("g1",)]
    assert plain(engine.sparql("SELECT ?s { ?s v:p ?o }", readable=[""])) == [("c",)]
    assert plain(engine.sparql("SELECT ?s ?o { ?s v:p ?o }", default_graphs=["g1"])) == [("a", "b")]


def test_updates_and_time_travel(engine):
    t = engine.insert([("", "a", V + "n", Value.of("Al")), ("", "b", V + "n", Value.of("Bo"))])
    assert engine.update("DELETE { ?s v:n ?x } INSERT { ?s v:name ?x } WHERE { ?s v:n ?x }") == [(2, 2)]
    assert plain(engine.sparql("SELECT ?s { ?s v:name ?x }")) == [("a",), ("b",)]
    assert plain(engine.sparql("SELECT ?s { ?s v:n ?x }", tt=t)) == [("a",), ("b",)]
    assert engine.update("DELETE DATA { <a> v:name 'Al' }", dry_run=True) == [(0, 1)]
    engine.update("DELETE DATA { <a> v:name 'Al' } ; MOVE DEFAULT TO <h> ; CREATE GRAPH <x>")
    assert plain(engine.sparql("SELECT ?g ?s { GRAPH ?g { ?s v:name ?x } }")) == [("h", "b")]
    engine.update("DROP GRAPH <h>")
    assert plain(engine.sparql("SELECT ?s { ?s ?p ?x }")) == []


def test_conflicts(engine):
    engine.insert([("", "a", V + "n", Value.of(1))])
    tx = engine.store.begin()
    tx.add(rdf.quads_of(engine.spark, [("", "a", V + "n", Value.of(2))]))
    assert tx.snapshot().scan(p=U(V + "n")).select("o.int").collect()[0][0] == 2
    engine.insert([("", "a", V + "n", Value.of(2))])
    with pytest.raises(Conflict):
        tx.commit()
    with pytest.raises(Conflict):
        engine.store._enter({"ts": 0, "id": "x", "parts": []}, 0)


def test_cypher_reads_and_writes(engine):
    engine.cypher("CREATE (a:Person {name: 'Ann', age: 41})")
    engine.cypher("MERGE (a:Person {name: 'Ann'})")
    engine.cypher("CREATE (b:Person {id: 'urn:bob', name: 'Bob', age: -3})")
    rows = engine.cypher("MATCH (p:Person) WHERE p.age > -5 RETURN p.name AS n, p.age AS a ORDER BY p.name").collect()
    assert [tuple(r) for r in rows] == [("Ann", "41"), ("Bob", "-3")]
    engine.cypher("MATCH (p:Person {name: 'Ann'}) SET p.age = 42")
    assert engine.cypher("MATCH (p:Person {name: $n}) RETURN p.age AS a", {"n": "Ann"}).collect()[0].a == "42"
    engine.cypher("MATCH (p:Person {name: 'Bob'}) DELETE p")
    assert engine.cypher("MATCH (p:Person) RETURN count(*) AS n").collect()[0].n == 1
    with pytest.raises(SyntaxError):
        parse_cypher("MATCH (a RETURN a")
    with pytest.raises(KeyError):
        engine.cypher("MATCH (p:Person {name: $missing}) RETURN p")


def test_owl_rules(spark):
    rows = [("A", RDFS + "subClassOf", "B"), ("B", RDFS + "subClassOf", "C"), ("x", RDF_TYPE, "A"), ("p", RDFS + "domain", "D"), ("p", RDFS + "range", "R"), ("p", RDFS + "subPropertyOf", "q"), ("q", OWL + "inverseOf", "i"),
            ("s", RDF_TYPE, OWL + "SymmetricProperty"), ("t", RDF_TYPE, OWL + "TransitiveProperty"), ("x", "p", "y"), ("x", "s", "y"), ("a", "t", "b"), ("b", "t", "c"), ("x", OWL + "sameAs", "y"), ("y", OWL + "sameAs", "z")]
    quads = rdf.quads_of(spark, [("", s, p, U(o)) for s, p, o in rows])
    got = {(r.s, r.p, r.o.str) for r in owl.materialize(quads).collect()}
    want = {("A", RDFS + "subClassOf", "C"), ("x", RDF_TYPE, "B"), ("x", RDF_TYPE, "C"), ("x", RDF_TYPE, "D"), ("y", RDF_TYPE, "R"), ("x", "q", "y"), ("y", "i", "x"), ("y", "s", "x"), ("a", "t", "c"),
            ("y", OWL + "sameAs", "x"), ("z", OWL + "sameAs", "y"), ("x", OWL + "sameAs", "z"), ("z", OWL + "sameAs", "x")}
    assert got == want


def test_owl_across_graphs(spark):
    quads = rdf.quads_of(spark, [("g1", "a", "t", U("b")), ("g2", "b", "t", U("c")), ("g1", "t", RDF_TYPE, U(OWL + "TransitiveProperty"))])
    assert {(r.g, r.s, r.o.str) for r in owl.materialize(quads).collect()} == {("urn:q:inferred:cross", "a", "c")}


def test_owl_delete_and_rederive(spark):
    rows = [("", "t", RDF_TYPE, U(OWL + "TransitiveProperty")), *[("", a, "t", U(b)) for a, b in ("ab", "bc", "ac", "cd")]]
    quads = rdf.quads_of(spark, rows)
    gone = quads.where("s = 'a' AND o.str = 'b'")
    new = rdf.quads_of(spark, [("", "d", "t", U("e"))])
    after = quads.where("NOT (s = 'a' AND o.str = 'b')")
    want = {(r.s, r.o.str) for r in owl.materialize(after.unionByName(new)).collect()}
    got = {(r.s, r.o.str) for r in owl.incremental(quads, owl.materialize(quads), new, gone).collect()}
    assert got == want


def test_materialize_is_idempotent(engine):
    engine.insert([("", "A", RDFS + "subClassOf", U("B")), ("", "x", RDF_TYPE, U("A"))])
    assert engine.materialize() == (1, 0)
    assert engine.materialize() == (0, 0)
    engine.store.delete("x", graph="")
    assert engine.materialize() == (0, 1)


def test_shacl_overlay(engine):
    engine.insert([("", "a", RDF_TYPE, U(V + "T")), ("", "b", RDF_TYPE, U(V + "T")), ("", "b", V + "n", Value.of("x"))])
    shapes = "@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix v: <urn:v:> . v:S sh:targetClass v:T ; sh:property [ sh:path v:n ; sh:minCount 1 ] ; sh:closed true ; sh:ignoredProperties ( <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> ) ."
    assert [r.focus for r in engine.validate_shapes(shapes).collect()] == ["a"]
    add = rdf.quads_of(engine.spark, [("", "a", V + "n", Value.of("y"))])
    assert engine.validate_shapes(shapes, adds=add).count() == 0
    gone = rdf.quads_of(engine.spark, [("", "b", V + "n", Value.of("x"))])
    assert [r.focus for r in engine.validate_shapes(shapes, retracts=gone).collect()] == ["b"]


def test_rdf_formats(spark, tmp_path):
    turtle = """@prefix v: <urn:v:> . v:a a v:T ; v:n "x\\"y\\n"@en, 5, 2.5, true, "2020-01-01"^^<http://www.w3.org/2001/XMLSchema#date> ; v:k [ v:m v:b ] ; v:l ( 1 2 ) . _:z v:p _:z ."""
    rows = rdf.parse_turtle(turtle)
    quads = rdf.quads_of(spark, rows)
    want = sorted((r.s, r.p, r.o.key) for r in quads.collect())
    for fmt in ("nt", "nq", "ttl", "trig", "jsonld"):
        rdf.write(quads, str(tmp_path / fmt), fmt)
        back = rdf.read(spark, str(tmp_path / fmt), fmt)
        assert sorted((r.s, r.p, r.o.key) for r in back.collect()) == want, fmt
    (tmp_path / "bad.nt").write_text("<a> <b> <c> .\nnonsense\n# note\n<a> <b> \"\" .\n")
    good, bad = rdf.read_lines(spark, str(tmp_path / "bad.nt"))
    assert good.count() == 2 and bad.count() == 1
    graphs = rdf.parse_turtle("<g> { <a> <p> <b> } GRAPH <h> { <a> <p> 1 } <c> <p> <d> .")
    assert sorted(r[0] for r in graphs) == ["", "g", "h"]
    jsonld = '{"@context": {"n": "urn:n", "k": {"@id": "urn:k", "@type": "@id"}}, "@id": "urn:a", "@type": "urn:T", "n": ["x", {"@value": "y", "@language": "fr"}], "k": "urn:b"}'
    assert sorted((p, o.kind) for _, _, p, o in rdf.parse_jsonld(jsonld)) == [(RDF_TYPE, "U"), ("urn:k", "U"), ("urn:n", "L"), ("urn:n", "S")]


def test_registry():
    r = Registry()
    r.register_node(NodeType("A", {"n": Field("text", True)}))
    r.register_node(NodeType("B", {"m": Field("int")}, ("A",)))
    assert list(r.fields("B")) == ["n", "m"] and r.subtypes("A") == ["A", "B"]
    with pytest.raises(ValueError):
        r.register_node(NodeType("A", {}, ("B",)))
    r.register_edge(EdgeType("e", "A", "B", inverse="f"))
    assert r.predicates_between("B", "B") == ["e"] and r.predicates_between("A", "A") == []
    assert Registry.from_triples(r.triples()).edges["e"].inverse == "f"


def test_patterns_and_vocabulary():
    v = Vocabulary("urn:b:", {"x": "http://x/"})
    p = parse_pattern('?s x:p "a b"@en @<g>', v)
    assert p.p == U("http://x/p") and p.o == Value("L", "a b", "en") and p.graph.iris == ("g",)
    assert parse_pattern("_ :name ?o @default", v).p == U("urn:b:name")
    assert v.compact("http://x/p") == "x:p" and v.compact("urn:b:q") == "q"
    steps = explain([parse_pattern("?a knows ?b"), parse_pattern("?b knows ?c")])
    assert [s["reads"] for s in steps] == ["p", "sp"]
    with pytest.raises(ValueError):
        parse_pattern("?a ?b")


def test_vectors(engine):
    vec = engine.spark.createDataFrame([("s", "a", [1.0, 0.0]), ("s", "b", [0.0, 1.0]), ("s", "c", [0.6, 0.8]), ("s", "z", [0.0, 0.0])], "space string, node string, vec array<double>")
    engine.store.commit(rdf.quads_of(engine.spark, [("", n, RDF_TYPE, U(V + ("T" if n != "a" else "X"))) for n in "abcz"]).select("g", "s", "p", "o"), vectors=vec)
    for _ in range(2):  # exactly, then by the index
        got = engine.vector_search("s", [1.0, 0.0], 5).collect()
        assert [(r.node, round(r.score, 6)) for r in got] == [("a", 1.0), ("c", 0.6), ("b", 0.0), ("z", 0.0)]
        assert [r.node for r in engine.vector_search("s", [1.0, 0.0], 1, node_type=V + "T").collect()] == ["c"]
        assert engine.cypher("MATCH (n:T) WHERE VECTOR_NEAR(n, 's', 1) RETURN n", near={"s": [1.0, 0.0]}).collect()[0].n == "c"
        assert engine.cypher("CALL VECTOR_NEAR(n, 's', 1, ef = 50) YIELD n, score MATCH (n) RETURN n, score", near={"s": [0.0, 1.0]}).collect()[0].n == "b"
        engine.store.index_vectors("s")
    with pytest.raises(ValueError, match="1 components"):
        engine.store.commit(vectors=engine.spark.createDataFrame([("s", "w", [1.0])], "space string, node string, vec array<double>"))
    with pytest.raises(ValueError):
        engine.store.commit(vectors=engine.spark.createDataFrame([("t", "w", [1.0]), ("t", "x", [1.0, 2.0])], "space string, node string, vec array<double>"))
    assert engine.store.index_vectors("empty") and engine.store.nearest("empty", [1.0], 3).count() == 0


def test_two_writers_of_one_number(spark, tmp_path):
    """Clocks stand still and both saw the same log: the first commit stands, the other leaves nothing."""
    first, second = (Store(spark, str(tmp_path / "s"), lambda: 500) for _ in range(2))
    quad = lambda o: rdf.quads_of(spark, [("", "a", "p", U(o))]).select("g", "s", "p", "o")
    first.commit(quad("base"))
    begun = second._begin()
    second._begin = lambda: begun
    first.commit(quad("kept"))
    with pytest.raises(Conflict):
        second.commit(quad("lost"))
    for st in (first, Store(spark, str(tmp_path / "s"))):
        assert sorted(r.o.str for r in st.live().collect()) == ["base", "kept"]


def test_subscribers_see_commits_that_stand(spark, tmp_path):
    st = Store(spark, str(tmp_path / "s"), itertools.count(100, 100).__next__)
    quad = lambda o: rdf.quads_of(spark, [("", "a", "p", U(o))]).select("g", "s", "p", "o")
    seen: list = []
    follow = lambda: changes.subscribe(spark, st, lambda df, i: seen.extend(r.o.str for r in df.collect()), str(tmp_path / "c")).awaitTermination()
    follow()
    st.commit(quad("one"))
    real = st._enter

    def fail(entry, number):
        raise OSError("the log cannot be written")

    st._enter = fail
    with pytest.raises(OSError):
        st.commit(quad("never"))
    st._enter = real
    follow()
    publish, st.publish = st.publish, lambda: None  # a writer that dies once its commit stands
    st.commit(quad("two"))
    st.publish = publish
    follow()
    assert seen == ["one", "two"]
    assert sorted(r.o.str for r in changes.batch(st).collect()) == ["one", "two"]


def test_log_entries_that_are_not_finished(spark, tmp_path):
    st = Store(spark, str(tmp_path / "s"))
    quad = lambda o: rdf.quads_of(spark, [("", "a", "p", U(o))]).select("g", "s", "p", "o")
    st.commit(quad("x"))
    (tmp_path / "s" / "log" / f"{1:012d}.json").write_text('{"ts": 9')
    again = Store(spark, str(tmp_path / "s"))
    again.commit(quad("y"))
    assert sorted(r.o.str for r in Store(spark, str(tmp_path / "s")).live().collect()) == ["x", "y"]


def test_compaction_keeps_every_read(spark, tmp_path):
    """Random commits against plain Python, before and after compactions, now and as of any commit."""
    rng = random.Random(3)
    st = Store(spark, str(tmp_path / "s"), itertools.count(100, 100).__next__)
    model: dict = {}
    past = {}
    frame = lambda rows: rdf.quads_of(spark, rows).select("g", "s", "p", "o")
    for turn in range(8):
        subjects = rng.sample("abcdef", 3)
        rows = [(rng.choice(["", "g"]), s, "p", Value.of(rng.randrange(4))) for s in subjects]
        mode = rng.choice(["add", "replace"])
        gone = [(*k, Value.of(v)) for k, vs in model.items() for v in vs if k[1] not in subjects and rng.random() < 0.3]
        at = st.commit(frame(rows), frame(gone) if gone else None, mode=mode)
        for g, s, p, o in rows:
            model[g, s, p] = (model.get((g, s, p), set()) if mode == "add" else set()) | {o.value}
        for g, s, p, o in gone:
            model[g, s, p].discard(o.value)
        past[at] = {(*k, v) for k, vs in model.items() for v in vs}
        if turn in (3, 5):
            st.compact()
            st.vacuum(older_seconds=0)
        read = lambda df: {(r.g, r.s, r.p, r.o.int) for r in df.collect()}
        assert read(st.live()) == past[at] == read(st.snapshot().scan(graph=Graph("all")))
        some = Value.of(rng.randrange(4))
        assert read(st.snapshot().scan(p=U("p"), o=some, graph=Graph("all"))) == {x for x in past[at] if x[3] == some.value}
    for at, want in past.items():
        assert read(st.live(tt=at)) == want
    st.retained = st.compact(tx_cutoff=max(past))
    assert read(st.live()) == past[max(past)]


def test_current_reads_have_no_shuffle(spark, tmp_path):
    st = Store(spark, str(tmp_path / "s"))
    st.bulk_load(rdf.quads_of(spark, [("", f"n{i}", "p", U(f"n{i // 2}")) for i in range(50)]))
    st.compact()
    plan = st.snapshot().scan(p=U("p"), o=U("n3"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "EqualTo(p,p)" in plan and "o.key" in plan.split("PushedFilters")[1]


def test_transactions_expire(engine):
    tx = engine.store.begin(idle_seconds=60)
    tx.add(rdf.quads_of(engine.spark, [("", "a", V + "n", Value.of(2))]))
    tx.used -= 61
    with pytest.raises(Expired):
        tx.commit()
    assert engine.store.log() == []


def test_deadline(engine):
    slow = engine.spark.range(4, numPartitions=4).select(F.expr("java_method('java.lang.Thread', 'sleep', 4000L)"))
    with pytest.raises(DeadlineExceeded), engine.deadline(0.7):
        slow.write.format("noop").mode("overwrite").save()
    with engine.deadline(30):
        assert engine.spark.range(3).count() == 3
    assert engine.spark.range(3).count() == 3


def unescaped(text):
    """A plain reader of the escapes of the line formats; None if they are wrong."""
    out, at = [], 0
    short = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}
    while at < len(text):
        if text[at] != "\\":
            out.append(text[at])
            at += 1
            continue
        kind = text[at + 1 : at + 2]
        if kind in short and kind:
            out.append(short[kind])
            at += 2
            continue
        n = {"u": 4, "U": 8}.get(kind)
        digits = text[at + 2 : at + 2 + n] if n else ""
        if not n or len(digits) < n or not all(c in "0123456789abcdefABCDEF" for c in digits) or int(digits, 16) > 0x10FFFF:
            return None
        out.append(chr(int(digits, 16)))
        at += 2 + n
    whole = "".join(out).encode("utf-16", "surrogatepass")
    try:
        return whole.decode("utf-16")
    except UnicodeDecodeError:
        return None


def test_rdf_escapes_against_brute_force(spark, tmp_path, engine):
    rng = random.Random(17)
    parts = ["a", "é", "\U0001f600", "\t", " ", "\\\\", '\\"', "\\'", "\\n", "\\t", "\\r", "\\b", "\\f", "\\u0041", "\\u00e9", "\\U0001F600", "\\uD83D\\uDE00", "\\uFEFF", "u0041", "'", "\\x", "\\u12", "\\uD83D", "\\U00110000"]
    texts = ["".join(rng.choice(parts[: 20 if n % 3 else 24]) for _ in range(rng.randrange(9))) for n in range(500)]
    (tmp_path / "x.nt").write_text("".join(f'<s{n}> <p> "{t}" .\n' for n, t in enumerate(texts)))
    good, bad = rdf.read_lines(spark, str(tmp_path / "x.nt"))
    got = {int(r.s[1:]): r.o.str for r in good.collect()}
    want = {n: unescaped(t) for n, t in enumerate(texts)}
    assert got == {n: t for n, t in want.items() if t is not None}
    assert bad.count() == sum(t is None for t in want.values()) > 0
    with pytest.raises(Malformed):
        engine.read_rdf(str(tmp_path / "x.nt"), "nt")
    assert engine.store.log() == []
    engine.read_rdf(str(tmp_path / "x.nt"), "nt", skip_malformed=True)
    assert engine.store.live().count() == len(got)


def test_joins_with_unbound_variables(spark):
    """All kinds of join on variables that are bound in some rows only, against brute force."""
    rng = random.Random(5)
    rows = {side: [tuple(rng.choice([None, "x", "y", "z"]) for _ in range(3)) for _ in range(14)] for side in "ab"}
    names = {"a": ("u", "v", "w"), "b": ("v", "w", "t")}

    def solutions(side, certain):
        own = [r for r in rows[side] if all(x is not None for n, x in zip(names[side], r, strict=True) if n in certain)]
        df = spark.createDataFrame(own, ", ".join(f"{n} string" for n in names[side])).select(*[terms.node(F.col(n)).alias(n) for n in names[side]])
        return Solutions(df, names[side], frozenset(certain)), [dict(zip(names[side], r, strict=True)) for r in own]

    for certain in (set(), {"v"}, {"v", "w"}):
        (a, left), (b, right) = solutions("a", certain - {"u"}), solutions("b", certain)
        agree = lambda x, y: all(x[n] is None or y[n] is None or x[n] == y[n] for n in ("v", "w"))
        overlap = lambda x, y: any(x[n] is not None and y[n] is not None for n in ("v", "w"))
        merged = lambda x, y: tuple(x.get(n) if x.get(n) is not None else (y or {}).get(n) for n in ("u", "v", "w", "t"))
        read = lambda s: sorted((tuple(r[n] and r[n].str for n in ("u", "v", "w", "t") if n in s.vars) for r in s.df.collect()), key=str)
        inner = [merged(x, y) for x in left for y in right if agree(x, y)]
        assert read(join(a, b)) == sorted(inner, key=str)
        alone = [x for x in left if not any(agree(x, y) for y in right)]
        assert read(join(a, b, "left")) == sorted(inner + [merged(x, None) for x in alone], key=str)
        three = lambda xs: sorted((tuple(x[n] for n in ("u", "v", "w")) for x in xs), key=str)
        assert read(join(a, b, "left_anti")) == three(alone)
        assert read(join(a, b, "left_semi")) == three([x for x in left if any(agree(x, y) for y in right)])
        assert read(join(a, b, "left_anti", overlap=True)) == three([x for x in left if not any(agree(x, y) and overlap(x, y) for y in right)])


def test_patterns_of_the_engine_that_runs_them(spark):
    ok = {r"\p{L}+": ("é", "1"), r"(?P<x>abc)": ("xabcx", "ab"), r"^[[:alpha:]]+$": ("ab", "a1"), r"[]a]": ("]", "b"), r"a{2,3}": ("caab", "ca"), r"\.": (".", "a"), r"\u{41}": ("A", "B"), "(?i)AB": ("xab", "b"), r"[(?=]": ("(", "b")}
    for pattern, (yes, no) in ok.items():
        translated = java_pattern(pattern, spark)
        assert translated is not None, pattern
        assert [r[0] for r in spark.createDataFrame([(yes,), (no,)], "t string").select(F.col("t").rlike(translated)).collect()] == [True, False], pattern
    assert [java_pattern(p, spark) for p in (r"(?=a)", r"(?<!a)b", r"(a)\1", "(", "[a", r"(?>a)", "[[:nope:]]")] == [None] * 7


def test_inference_by_log_and_in_whole_agree(engine):
    """Random changes of a small graph with every kind of rule; each run by the log gives what a whole run would."""
    rng = random.Random(23)
    rules = [("A", RDFS + "subClassOf", "B"), ("B", RDFS + "subClassOf", "C"), ("p", RDFS + "subPropertyOf", "q"), ("q", OWL + "inverseOf", "i"), ("q", RDF_TYPE, OWL + "TransitiveProperty"), ("p", RDFS + "domain", "A"), ("i", RDFS + "range", "D"), ("s", RDF_TYPE, OWL + "SymmetricProperty"), ("s", RDFS + "subPropertyOf", "q")]
    engine.insert([("", s, p, U(o)) for s, p, o in rules])
    facts: set = set()
    for _ in range(3):
        add = {("", rng.choice("mnox"), rng.choice("pqs"), rng.choice("mnox")) for _ in range(4)} - facts
        gone = set(rng.sample(sorted(facts), min(3, len(facts))))
        frame = lambda rows: rdf.quads_of(engine.spark, [(g, s, p, U(o)) for g, s, p, o in sorted(rows)]).select("g", "s", "p", "o") if rows else None
        engine.store.commit(frame(add), frame(gone))
        facts = facts - gone | add
        engine.materialize()
        live = engine.store.live()
        got = {(r.g, r.s, r.p, r.o.key) for r in live.where(F.col("g").startswith("urn:q:inferred:")).collect()}
        assert got == {(r.g, r.s, r.p, r.o.key) for r in owl.materialize(live.select("g", "s", "p", "o")).collect()}


def test_small_and_large_schemas_agree(spark, monkeypatch):
    """The closed form on the driver and the distributed rounds, over random schemas in several graphs."""
    rng = random.Random(31)
    for _ in range(3):
        rows = []
        for _ in range(7):
            kind = rng.choice([RDFS + "subClassOf", RDFS + "subPropertyOf", RDFS + "domain", RDFS + "range", OWL + "inverseOf", "sym", "trans"])
            a, b = (rng.choice("ABC"), rng.choice("ABC")) if kind.endswith("subClassOf") else (rng.choice("pqr"), rng.choice("ABC") if kind.endswith(("domain", "range")) else rng.choice("pqr"))
            g = rng.choice(["", "g"])
            rows.append((g, a, RDF_TYPE, U(OWL + "SymmetricProperty")) if kind == "sym" else (g, a, RDF_TYPE, U(OWL + "TransitiveProperty")) if kind == "trans" else (g, a, kind, U(b)))
        rows += [(rng.choice(["", "g"]), rng.choice("xyz"), rng.choice("pqr"), U(rng.choice("xyz")) if rng.random() < 0.85 else Value.of(3)) for _ in range(7)]
        rows += [("", "x", RDF_TYPE, U("A")), ("", "x", OWL + "sameAs", U("y"))]
        quads = rdf.quads_of(spark, rows)
        read = lambda: {(r.g, r.s, r.p, r.o.key) for r in owl.materialize(quads).collect()}  # noqa: B023, E731
        small = read()
        monkeypatch.setattr(owl, "SMALL", -1)
        assert small == read()
        monkeypatch.undo()


def test_scratch_needs_a_shared_folder():
    class Conf(dict):
        def get(self, key, default=None):
            return default

    class Fake:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"

            @staticmethod
            def getConf():
                return Conf()

    with pytest.raises(RuntimeError):
        scratch_root(Fake)


def test_sparql_syntax_errors(spark):
    s = Sparql(Snapshot.of(rdf.quads_of(spark, [("", "a", "p", U("b"))])), spark)
    for bad in ("SELECT ?x WHERE { ?x", "SELECT ?x { ?x nope:p ?y }", "FETCH ?x { }"):
        with pytest.raises(SyntaxError):
            s.run(bad)
    with pytest.raises(NotImplementedError):
        s.run("SELECT ?x { SERVICE <u> { ?x ?p ?o } }")
