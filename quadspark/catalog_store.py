"""Queries over the bitemporal store and the engine, each with its SQL: reads of what was loaded, committed
and compacted, writes of every kind, formats, the feed, vectors, inference, shapes and upkeep.

They belong to the catalog, whose tables of queries and SQL they extend.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadspark.catalog import AS_OF, D, EDGES, GRAPHS, OWL_COUNTS, PREFIXES, P, U, V, company, first_vector, query, referral_quads, replaced_versions, segment_graphs, space, store, table, texts, ticking
from quadspark.engine import Engine
from quadspark.functions import terms
from quadspark.functions.terms import OWL, RDF_TYPE, RDFS, Value
from quadspark.operators import access, ontology, owl, shacl, snapshot, vectors
from quadspark.operators.snapshot import INFERRED, Snapshot
from quadspark.operators.store import Store
from quadspark.plans.build import Builder, explain
from quadspark.plans.cypher import Cypher
from quadspark.plans.patterns import Graph, Pattern, Query, Rule, Vocabulary, parse_pattern
from quadspark.plans.sparql import Sparql
from quadspark.scratch import Scratch
from quadspark.sources import rdf
from quadspark.sources.tables import TABLES, TableStore, iri
from quadspark.streaming import changes

TYPE = RDF_TYPE
COLS = ["g", "s", "p", "o"]
_LOADED: dict[tuple[str, str], Store] = {}


def fresh(spark: SparkSession, name: str) -> Store:
    return Store(spark, Scratch(spark, f"{name}-query").root, ticking())


def quads_of_tables(spark: SparkSession, folder: str, *names: str) -> DataFrame:
    tables = tuple(t for t in TABLES if t.name in names)
    return rdf.with_edges(TableStore(spark, folder, tables).snapshot().scan().select(*COLS))


def loaded(spark: SparkSession, folder: str) -> Engine:
    """A compacted store of five whole tables and the referrals of customers, loaded once a session."""
    key = spark.sparkContext.applicationId, folder
    if key not in _LOADED:
        st = fresh(spark, "loaded")
        st.bulk_load(quads_of_tables(spark, folder, "region", "nation", "customer", "supplier", "orders").unionByName(rdf.with_edges(referral_quads(spark, folder).select(*COLS))))
        st.compact()
        _LOADED[key] = st
    return Engine(spark, _LOADED[key], Vocabulary(D, dict(PREFIXES)))


def geography(spark: SparkSession, folder: str, name: str) -> Engine:
    """An engine on a store of its own with nations, regions and suppliers."""
    st = fresh(spark, name)
    st.bulk_load(quads_of_tables(spark, folder, "region", "nation", "supplier"))
    return Engine(spark, st, Vocabulary(D, dict(PREFIXES)))


def graph_store(spark: SparkSession, folder: str, name: str) -> Engine:
    """An engine on a store of its own with customers' nations in a graph a segment."""
    st = fresh(spark, name)
    st.commit(segment_graphs(spark, folder).select(*COLS))
    return Engine(spark, st, Vocabulary(D, dict(PREFIXES)))


def counted(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def constant(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    return spark.createDataFrame(rows, ddl)


# --- reads of the store -----------------------------------------------------------------------------


@query("""SELECT p, CAST(sum(n) AS BIGINT) AS n FROM (SELECT 'urn:d:' || unnest(['o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority']) AS p, n FROM (SELECT count(*) AS n FROM orders)
UNION ALL SELECT 'urn:d:' || unnest(['c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment', 'refers']), n FROM (SELECT count(*) AS n FROM customer) UNION ALL SELECT 'urn:d:' || unnest(['s_name', 's_nationkey', 's_acctbal']), n FROM (SELECT count(*) AS n FROM supplier)
UNION ALL SELECT 'urn:d:' || unnest(['n_name', 'n_regionkey']), n FROM (SELECT count(*) AS n FROM nation) UNION ALL SELECT 'urn:d:r_name', count(*) FROM region
UNION ALL SELECT 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM orders)) GROUP BY p""")
def store_bulk_load(spark, folder):
    return counted(loaded(spark, folder).snapshot().scan(), "p")


@query("SELECT 'urn:d:orders:' || o_orderkey AS o, 'urn:d:nation:' || c_nationkey AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def store_bgp(spark, folder):
    rows = loaded(spark, folder).datalog([Pattern(V("o"), P("o_custkey"), V("c")), Pattern(V("c"), P("c_nationkey"), V("n")), Pattern(V("c"), P("c_mktsegment"), Value("S", "BUILDING"))])
    return texts(rows, o="o", n="n")


@query("SELECT 'urn:d:nation:' || n_nationkey AS n, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def store_cypher(spark, folder):
    df = loaded(spark, folder).cypher("MATCH (o:Orders)-[:o_custkey]->(c:Customer)-[:c_nationkey]->(n:Nation) RETURN n, count(*) AS n_orders, sum(o.o_totalprice) AS total")
    return df.withColumn("total", F.round("total", 2))


@query("SELECT r_name AS r, count(*) AS n, round(avg(c_acctbal), 4) AS a FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 0 GROUP BY r_name")
def store_sparql(spark, folder):
    r = loaded(spark, folder).sparql("SELECT ?r (COUNT(*) AS ?n) (AVG(?b) AS ?a) { ?c d:c_nationkey/d:n_regionkey ?g ; d:c_acctbal ?b . ?g d:r_name ?r FILTER(?b > 0) } GROUP BY ?r")
    return texts(r.solutions, r="r", n="n:i", a="a:n").withColumn("a", F.round("a", 4))


@query(f"WITH RECURSIVE e AS {EDGES}, r AS (SELECT s, o FROM e UNION SELECT r.s, e.o FROM r JOIN e ON r.o = e.s) SELECT s, o FROM r")
def store_path(spark, folder):
    return texts(loaded(spark, folder).sparql("SELECT ?s ?o { ?s d:refers+ ?o }").solutions, s="s", o="o")


@query("SELECT 'urn:d:customer:' || c_custkey AS s FROM customer WHERE c_nationkey = 3")
def store_scan_object(spark, folder):
    """A bound predicate and object reach the scan of the state."""
    return loaded(spark, folder).snapshot().scan(p=P("c_nationkey"), o=U("urn:d:nation:3")).select("s")


@query("""SELECT 'urn:d:customer:' || c_custkey AS s, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE c_acctbal END AS bal FROM customer WHERE c_custkey % 7 <> 0""")
def store_commits_on_state(spark, folder):
    """Commits after the compaction are laid on its state: a replaced balance, a closed segment."""
    st = fresh(spark, "laid")
    snap = store(spark, folder)
    st.bulk_load(rdf.with_edges(snap.source(D + "c_acctbal").unionByName(snap.source(D + "c_mktsegment")).select(*COLS)))
    st.compact()
    number = F.regexp_extract("s", r"(\d+)$", 1).cast("bigint")
    st.commit(snap.source(D + "c_acctbal").where(number % 5 == 0).withColumn("o", terms.double(F.lit(0.0))).select(*COLS), mode="replace")
    st.commit(retracts=snap.source(D + "c_mktsegment").where(number % 7 == 0).select(*COLS))
    rows = Builder(st.snapshot(), spark).conjunction([Pattern(V("c"), P("c_acctbal"), V("b")), Pattern(V("c"), P("c_mktsegment"), V("g"))])
    return texts(rows, s="c", bal="b:n")


@query("""SELECT 'before' AS at, round(sum(c_acctbal), 2) AS total FROM customer UNION ALL SELECT 'after', round(sum(CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE c_acctbal END), 2) FROM customer""")
def store_time_travel_compacted(spark, folder):
    """What was known before a replacement, read after a compaction of both."""
    st = fresh(spark, "travel")
    snap = store(spark, folder)
    first = st.commit(snap.source(D + "c_acctbal").select(*COLS))
    number = F.regexp_extract("s", r"(\d+)$", 1).cast("bigint")
    st.commit(snap.source(D + "c_acctbal").where(number % 5 == 0).withColumn("o", terms.double(F.lit(0.0))).select(*COLS), mode="replace")
    st.compact()
    sums = lambda name, df: df.agg(F.lit(name).alias("at"), F.round(F.sum("o.dbl"), 2).alias("total"))
    return sums("before", st.live(tt=first)).unionByName(sums("after", st.live()))


@query(f"SELECT s, p, count(*) AS n FROM (SELECT 'urn:d:user:' || user_id AS s, 'urn:d:' || event_type AS p, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r, epoch_us(ts) AS t, lead(epoch_us(ts)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS e FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL AND ts IS NOT NULL) WHERE coalesce(e, 9223372036854775807) >= {AS_OF} GROUP BY s, p")
def store_retention(spark, folder):
    """A compaction that leaves out quads that had ended by a moment."""
    st = fresh(spark, "retention")
    quads = replaced_versions(spark, folder).withColumn("g", F.concat(F.lit("urn:t:"), F.col("tt").cast("string")))
    st.commit(versions=quads)
    st.compact(vt_cutoff=AS_OF)
    return counted(st.versions(), "s", "p")


@query("SELECT 'backup' AS name, count(*) AS n FROM nation UNION ALL SELECT 'vacuumed', count(*) FROM nation UNION ALL SELECT 'gone', 2")
def store_backup_and_vacuum(spark, folder):
    """A copy of the store reads the same; what a compaction merged is deleted, and reads stay the same."""
    st = fresh(spark, "backup")
    names = store(spark, folder).source(D + "n_name").select(*COLS)
    st.commit(names.where("s < 'urn:d:nation:2'"))
    st.commit(names.where("s >= 'urn:d:nation:2'"))
    st.compact()
    target = f"{Scratch(spark, 'backup-copy').root}/copy"
    st.backup(target)
    gone = st.vacuum(older_seconds=0)
    rows = [("backup", Store(spark, target).live().count()), ("vacuumed", st.live().count()), ("gone", gone)]
    return constant(spark, rows, "name string, n bigint")


@query(f"SELECT g, s FROM {GRAPHS} WHERE s = 'urn:d:customer:4' AND g = ''")
def graph_subject_scan(spark, folder):
    return Snapshot.of(segment_graphs(spark, folder)).scan(s=U("urn:d:customer:4"), graph=Graph("one", ("",))).select("g", "s")


@query("SELECT 'urn:d:quantity' AS p, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS total FROM lineitem")
def annotation_scan(spark, folder):
    notes = TableStore(spark, folder).lineitem_annotations()
    return snapshot.scan_annotations(notes, p=D + "quantity").groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.sum("o.dbl").alias("total"))


@query(f"SELECT count(DISTINCT s) AS ids FROM {GRAPHS} WHERE s = 'urn:d:customer:4'")
def edge_ids_of_triple(spark, folder):
    """One triple in several graphs has one edge id."""
    st = graph_store(spark, folder, "edges").store
    o = st.live().where("s = 'urn:d:customer:4'").select("o.str").first()[0]
    return snapshot.edge_ids(st.versions(), "urn:d:customer:4", D + "c_nationkey", U(o)).agg(F.count(F.lit(1)).alias("ids"))


@query("SELECT 'urn:d:supplier:' || s_suppkey AS s, CASE WHEN s_suppkey % 5 = 0 THEN 0 ELSE s_acctbal END AS bal FROM supplier")
def transaction_reads_own_writes(spark, folder):
    """Pending balances hide the stored ones inside the transaction; nothing of it is written."""
    e = geography(spark, folder, "overlay")
    tx = e.store.begin()
    zero = store(spark, folder).source(D + "s_acctbal").where(F.regexp_extract("s", r"(\d+)$", 1).cast("bigint") % 5 == 0).withColumn("o", terms.double(F.lit(0.0)))
    tx.add(zero)
    rows = Builder(tx.snapshot(), spark).conjunction([Pattern(V("s"), P("s_acctbal"), V("b"))])
    out = Scratch(spark, "overlay-rows").save(texts(rows, s="s", bal="b:n"), "rows")
    tx.rollback()
    return out


@query("SELECT 'rolled back' AS what, (SELECT count(*) FROM supplier) AS n UNION ALL SELECT 'committed', (SELECT count(*) FROM supplier) - (SELECT count(*) FROM supplier WHERE s_suppkey % 2 = 0)")
def transaction_commit_and_rollback(spark, folder):
    e = geography(spark, folder, "tx")
    names = store(spark, folder).source(D + "s_name").where(F.regexp_extract("s", r"(\d+)$", 1).cast("bigint") % 2 == 0)
    count = lambda: e.snapshot().scan(p=P("s_name")).count()
    tx = e.store.begin()
    tx.retract(names)
    tx.rollback()
    after_rollback = count()
    with e.store.begin() as tx:
        tx.retract(names)
    return constant(spark, [("rolled back", after_rollback), ("committed", count())], "what string, n bigint")


@query("SELECT 'all' AS scope, 2 * (SELECT count(*) FROM nation) AS n UNION ALL SELECT 'asserted', count(*) FROM nation")
def inferred_opt_out(spark, folder):
    names = store(spark, folder).source(D + "n_name").select(*COLS)
    both = rdf.with_edges(names.unionByName(names.withColumn("g", F.lit(INFERRED)).withColumn("p", F.lit(D + "label"))))
    snap = Snapshot.of(both)
    rows = [("all", snap.scan().count()), ("asserted", snap.restricted(inferred=False).scan().count())]
    return constant(spark, rows, "scope string, n bigint")


@query("SELECT 'urn:d:nation:' || n_nationkey AS n, 'urn:d:region:' || n_regionkey AS r FROM nation WHERE n_regionkey = 2")
def text_patterns(spark, folder):
    e = loaded(spark, folder)
    return texts(e.datalog(["?n n_regionkey ?r", '?n <urn:d:n_regionkey> <urn:d:region:2>', "?r <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> Region"]), n="n", r="r")


@query("SELECT 0 AS step, 'p' AS reads, 'a,b' AS binds, false AS recursive UNION ALL SELECT 1, 'sp', 'c', false UNION ALL SELECT 2, 'derived', 'd', true")
def explain_steps(spark, folder):
    steps = explain([parse_pattern("?a knows ?b"), parse_pattern("?b knows ?c"), parse_pattern("?c reach ?d")], [Rule("reach", "x", "y", (parse_pattern("?x knows ?y"),))])
    return constant(spark, [(s["step"], s["reads"], ",".join(s["binds"]), s["recursive"]) for s in steps], "step int, reads string, binds string, recursive boolean")


@query("SELECT 'urn:d:nation:' || n_nationkey AS n, 'urn:d:region:' || r_regionkey AS r FROM nation, region")
def cross_product(spark, folder):
    return texts(loaded(spark, folder).datalog([Pattern(V("n"), U(TYPE), P("Nation")), Pattern(V("r"), U(TYPE), P("Region"))]), n="n", r="r")


@query(f"SELECT DISTINCT s, o FROM (SELECT g, s, 'urn:d:nation:' || k AS o FROM {GRAPHS}) WHERE g = 'urn:g:BUILDING'")
def rules_in_a_graph(spark, folder):
    """A rule's body looks in the graph that the query is scoped to."""
    b = Builder(Snapshot.of(segment_graphs(spark, folder)), spark)
    q = Query([Pattern(V("x"), U("near"), V("y"))], [Rule("near", "x", "y", (Pattern(V("x"), P("c_nationkey"), V("y")),))])
    return texts(b.query(q.scoped(Graph("one", ("urn:g:BUILDING",)))), s="x", o="y")


@query("SELECT 'typed' AS what, 1 AS n UNION ALL SELECT 'untyped', 0")
def schema_pruned_scan(spark, folder):
    """A subject that is no nation has no region by the registered types; a nation has."""
    e = loaded(spark, folder)
    r = ontology.Registry()
    r.register_edge(ontology.EdgeType(D + "n_regionkey", D + "Nation", D + "Region"))
    b = Builder(e.snapshot(), spark, r)
    stray = Builder(Snapshot.of(rdf.quads_of(spark, [("", D + "stray", D + "n_regionkey", U(D + "region:1"))])), spark, r)
    count = lambda b, s: b.scan(Pattern(U(s), P("n_regionkey"), V("x"))).df.count()
    return constant(spark, [("typed", count(b, D + "nation:3")), ("untyped", count(stray, D + "stray"))], "what string, n int")


@query("""SELECT 'indexed' AS how, 'urn:d:customer:' || c_custkey AS s FROM customer WHERE contains(lower(c_name), 'er#00000001') UNION ALL SELECT 'scanned', 'urn:d:customer:' || c_custkey FROM customer WHERE contains(lower(c_name), 'er#00000001')
UNION ALL SELECT 'short', 'urn:d:customer:' || c_custkey FROM customer WHERE contains(c_mktsegment, 'BU')""")
def text_index(spark, folder):
    """Text search by trigrams, by a scan once something was committed after the index, and for two letters."""
    st = fresh(spark, "text")
    snap = store(spark, folder)
    st.bulk_load(rdf.with_edges(snap.source(D + "c_name").unionByName(snap.source(D + "c_mktsegment")).select(*COLS)))
    st.compact()
    st.index_text()
    e = Engine(spark, st)
    scratch = Scratch(spark, "text-rows")
    found = lambda how, text: scratch.save(e.text_search(text).select(F.lit(how).alias("how"), "s"), how)
    out = found("indexed", "ER#00000001").unionByName(found("short", "bu"))
    e.insert([("", "urn:x", D + "note", Value("S", "other"))])
    return out.unionByName(found("scanned", "er#00000001"))


# --- Cypher ------------------------------------------------------------------------------------------------


def referral_cypher(spark, folder, text: str) -> DataFrame:
    return Cypher(Snapshot(lambda p: referral_quads(spark, folder), one_graph=True), spark, Vocabulary(D)).run(text)


@query(f"WITH RECURSIVE e AS {EDGES}, r AS (SELECT s, o FROM e UNION SELECT r.s, e.o FROM r JOIN e ON r.o = e.s) SELECT o AS b, count(*) AS n FROM r GROUP BY o")
def cypher_path_star(spark, folder):
    return referral_cypher(spark, folder, "MATCH (a)-[:refers*]->(b) RETURN b, count(*) AS n")


@query(f"""WITH e AS {EDGES}, r2 AS (SELECT DISTINCT a.s, b.o FROM e a JOIN e b ON a.o = b.s), r3 AS (SELECT DISTINCT r2.s, e.o FROM r2 JOIN e ON r2.o = e.s) SELECT s AS a, o AS b FROM r2 UNION SELECT s, o FROM r3""")
def cypher_path_range(spark, folder):
    return referral_cypher(spark, folder, "MATCH (a)-[:refers*2..3]->(b) RETURN a, b")


@query("SELECT 'urn:d:nation:' || c_nationkey AS n, count(*) AS pairs FROM customer JOIN supplier ON c_nationkey = s_nationkey GROUP BY 1")
def cypher_comma_paths(spark, folder):
    return loaded(spark, folder).cypher("MATCH (c)-[:c_nationkey]->(n), (s)-[:s_nationkey]->(n) RETURN n, count(*) AS pairs")


@query("SELECT 'urn:d:nation:' || c_nationkey AS n, count(*) AS c FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1")
def cypher_use_graph(spark, folder):
    return graph_store(spark, folder, "use-graph").cypher("USE GRAPH <urn:g:BUILDING> MATCH (c)-[:c_nationkey]->(n) RETURN n, count(*) AS c")


@query("SELECT 'urn:d:part:' || p_partkey AS p FROM part WHERE regexp_matches(p_name, '^[a-z]+ [a-m]\\p{L}*$')")
def cypher_regex_classes(spark, folder):
    return Cypher(store(spark, folder), spark, Vocabulary(D)).run(r"MATCH (p:Part) WHERE p.p_name =~ '^(?P<first>[[:lower:]]+) [a-m]\\p{L}*$' RETURN p")


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(ceil(count(*) / 7.0) AS BIGINT) AS chunks FROM supplier")
def result_streaming(spark, folder):
    e = loaded(spark, folder)
    sizes = [len(chunk) for chunk in e.stream_rows(e.cypher("MATCH (s:Supplier) RETURN s"), 7)]
    return constant(spark, [(sum(sizes), len(sizes))], "n bigint, chunks bigint")


@query("SELECT 'urn:d:region:' || r_regionkey AS r, 'Team of ' || 1 AS name FROM region")
def cypher_match_create(spark, folder):
    """One node and one relation for every matched row."""
    e = geography(spark, folder, "create")
    e.cypher("MATCH (r:Region) CREATE (t:Team {name: 'Team of 1'})-[:covers]->(r)")
    return e.cypher("MATCH (t:Team)-[:covers]->(r) RETURN r, t.name AS name")


@query("SELECT (SELECT count(*) FROM region) AS covered, 1 AS teams")
def cypher_merge(spark, folder):
    """MERGE makes one node for all rows, finds it the next time, and adds no relation twice."""
    e = geography(spark, folder, "merge")
    for _ in range(2):
        e.cypher("MATCH (r:Region) MERGE (t:Team {name: 'one'})-[:covers]->(r)")
    return e.cypher("MATCH (t:Team)-[:covers]->(r) RETURN count(r) AS covered, count(DISTINCT t) AS teams").withColumn("teams", F.col("teams").cast("int"))


@query("SELECT 'urn:d:supplier:' || s_suppkey AS s, CASE WHEN s_acctbal > 0 THEN 'good' END AS state, s_acctbal AS bal FROM supplier")
def cypher_set(spark, folder):
    e = geography(spark, folder, "set")
    e.cypher("MATCH (s:Supplier) WHERE s.s_acctbal > 0 SET s.state = 'bad'")
    e.cypher("MATCH (s:Supplier) WHERE s.s_acctbal > 0 SET s.state = 'good'")
    return e.cypher("MATCH (s:Supplier) RETURN s, s.state AS state, s.s_acctbal AS bal").withColumn("bal", F.col("bal").cast("double"))


@query("SELECT 'urn:d:nation:' || n_nationkey AS n FROM nation WHERE n_regionkey <> 2")
def cypher_delete(spark, folder):
    e = geography(spark, folder, "delete")
    e.cypher("MATCH (n:Nation)-[:n_regionkey]->(r:Region {r_name: $name}) DELETE n", {"name": table(spark, folder, "region").where("r_regionkey = 2").first()["r_name"]})
    return e.cypher("MATCH (n:Nation) RETURN n")


@query("SELECT (SELECT count(*) FROM region) AS created, 2 * (SELECT count(*) FROM region) AS set, 1 AS commits")
def cypher_write_is_one_commit(spark, folder):
    e = geography(spark, folder, "atomic")
    before = len(e.store.log())
    made = e.cypher("MATCH (r:Region) CREATE (x:Mark) SET r.a = 1, r.b = 2").first()
    return constant(spark, [(made["created"], made["set"], len(e.store.log()) - before)], "created bigint, set bigint, commits int")


# --- SPARQL -----------------------------------------------------------------------------------------------


@query("SELECT 'urn:d:customer:' || c_custkey AS c FROM customer WHERE c_mktsegment = 'BUILDING'")
def sparql_graph_iri(spark, folder):
    return texts(Sparql(Snapshot.of(segment_graphs(spark, folder)), spark, PREFIXES).run("SELECT ?c { GRAPH <urn:g:BUILDING> { ?c d:c_nationkey ?n } }").solutions, c="c")


@query(f"SELECT DISTINCT s AS c FROM {GRAPHS} WHERE g IN ('urn:g:BUILDING', 'urn:g:MACHINERY')")
def sparql_from(spark, folder):
    return texts(Sparql(Snapshot.of(segment_graphs(spark, folder)), spark, PREFIXES).run("SELECT ?c FROM <urn:g:BUILDING> FROM <urn:g:MACHINERY> { ?c d:c_nationkey ?n }").solutions, c="c")


@query(f"SELECT g, count(*) AS n FROM {GRAPHS} WHERE g IN ('urn:g:BUILDING', 'urn:g:MACHINERY') GROUP BY g")
def sparql_from_named(spark, folder):
    r = Sparql(Snapshot.of(segment_graphs(spark, folder)), spark, PREFIXES).run("SELECT ?g (COUNT(*) AS ?n) FROM NAMED <urn:g:BUILDING> FROM NAMED <urn:g:MACHINERY> { GRAPH ?g { ?c d:c_nationkey ?x } } GROUP BY ?g")
    return texts(r.solutions, g="g", n="n:i")


@query("SELECT 'urn:d:nation:' || n_nationkey AS n, 'urn:d:region:' || n_regionkey AS r FROM nation")
def sparql_star_object(spark, folder):
    """Nodes that speak of a triple: the quoted triple as object."""
    edges = store(spark, folder).source(D + "n_regionkey").select(*COLS)
    edges = rdf.with_edges(edges)
    about = edges.select("g", F.concat(F.lit("urn:claim:"), F.col("s")).alias("s"), F.lit(D + "says").alias("p"), terms.node(F.col("edge_id")).alias("o"), F.lit(None).cast("string").alias("edge_id"))
    r = Sparql(Snapshot.of(edges.unionByName(about)), spark, PREFIXES).run("SELECT ?n ?r { ?claim d:says << ?n d:n_regionkey ?r >> }")
    return texts(r.solutions, n="n", r="r")


@query("SELECT 'urn:d:nation:' || c_nationkey AS n, min(c_mktsegment) AS seg FROM customer GROUP BY 1")
def sparql_sample(spark, folder):
    r = loaded(spark, folder).sparql("SELECT ?n (SAMPLE(?g) AS ?seg) { ?c d:c_nationkey ?n ; d:c_mktsegment ?g } GROUP BY ?n")
    return texts(r.solutions, n="n", seg="seg")


@query("""SELECT 'urn:d:customer:' || c_custkey AS c, CASE WHEN c_acctbal > 9000 THEN 'urn:d:nation:' || c_nationkey END AS n FROM customer WHERE NOT (c_acctbal > 9000 AND c_nationkey < 10)""")
def sparql_minus_unbound(spark, folder):
    """Rows whose shared variables are unbound agree with nothing in MINUS, and stay."""
    few = ", ".join(f"<urn:d:nation:{k}>" for k in range(10))
    r = loaded(spark, folder).sparql(f"""SELECT ?c ?n {{ ?c a d:Customer OPTIONAL {{ ?c d:c_acctbal ?b ; d:c_nationkey ?n FILTER(?b > 9000) }}
        MINUS {{ ?x d:c_nationkey ?n FILTER(?n IN ({few})) }} }}""")
    return texts(r.solutions, c="c", n="n")


@query("SELECT a.s AS x, b.o AS y FROM (SELECT 'urn:d:nation:' || n_nationkey AS s, CASE WHEN n_nationkey < 12 THEN 'urn:d:region:' || n_regionkey END AS r FROM nation) a JOIN (SELECT 'urn:d:region:' || r_regionkey AS o FROM region) b ON a.r IS NULL OR a.r = b.o")
def sparql_optional_then_join(spark, folder):
    """A join on a variable that only some rows bind: the others go with every partner."""
    few = ", ".join(f"<urn:d:nation:{k}>" for k in range(12))
    r = loaded(spark, folder).sparql(f"SELECT ?x ?y {{ {{ ?x a d:Nation OPTIONAL {{ ?x d:n_regionkey ?y FILTER(?x IN ({few})) }} }} {{ ?y a d:Region }} }}")
    return texts(r.solutions, x="x", y="y")


@query("SELECT 'urn:d:nation:' || n_nationkey AS s, n_name AS name FROM nation WHERE n_regionkey <> 1 UNION ALL SELECT 'urn:x', 'new'")
def sparql_update_data(spark, folder):
    e = geography(spark, folder, "update")
    e.update("INSERT DATA { <urn:x> d:label 'new' } ; DELETE { ?n d:n_name ?x } INSERT { ?n d:label ?x } WHERE { ?n d:n_name ?x } ; DELETE WHERE { ?n d:label ?x . ?n d:n_regionkey <urn:d:region:1> }")
    return texts(e.sparql("SELECT ?s ?name { ?s d:label ?name }").solutions, s="s", name="name")


@query(f"""SELECT g, n FROM (SELECT 'urn:copy' AS g, count(*) AS n FROM {GRAPHS} WHERE g = 'urn:g:BUILDING' UNION ALL SELECT 'urn:both', count(DISTINCT s) FROM {GRAPHS} WHERE g IN ('urn:g:BUILDING', '')
UNION ALL SELECT 'urn:g:BUILDING', count(*) FROM {GRAPHS} WHERE g = 'urn:g:BUILDING')""")
def sparql_update_graphs(spark, folder):
    """COPY, ADD, MOVE, CLEAR and DROP: what each leaves."""
    e = graph_store(spark, folder, "graph-ops")
    e.update("COPY <urn:g:BUILDING> TO <urn:copy> ; ADD <urn:g:BUILDING> TO <urn:both> ; ADD DEFAULT TO <urn:both> ; MOVE DEFAULT TO <urn:g:MACHINERY> ; DROP GRAPH <urn:g:MACHINERY> ; CLEAR GRAPH <urn:g:AUTOMOBILE>")
    e.update("DROP GRAPH <urn:g:HOUSEHOLD> ; DROP GRAPH <urn:g:FURNITURE>")
    return counted(e.store.live(), "g")


@query("SELECT 0 AS quads, 1 AS commits")
def sparql_drop_all(spark, folder):
    e = graph_store(spark, folder, "drop-all")
    before = len(e.store.log())
    e.update("DROP ALL")
    return constant(spark, [(e.store.live().count(), len(e.store.log()) - before)], "quads int, commits int")


# --- formats -------------------------------------------------------------------------------------------------


def round_trip(spark, folder, fmt: str) -> DataFrame:
    snap, scratch = store(spark, folder), Scratch(spark, f"{fmt}-query")
    named = snap.source(D + "n_name").unionByName(snap.source(D + "n_regionkey")).select(*COLS)
    rdf.write(named.withColumn("g", F.lit("urn:g:n")), f"{scratch.root}/{fmt}", fmt)
    back = rdf.read(spark, f"{scratch.root}/{fmt}", fmt, graph="urn:g:n")
    rows = Builder(Snapshot.of(back), spark).conjunction([Pattern(V("s"), P("n_name"), V("name"), Graph("one", ("urn:g:n",))), Pattern(V("s"), P("n_regionkey"), V("r"), Graph("one", ("urn:g:n",)))])
    return texts(rows, s="s", name="name", r="r")


NATIONS = "SELECT 'urn:d:nation:' || n_nationkey AS s, n_name AS name, 'urn:d:region:' || n_regionkey AS r FROM nation"


@query(NATIONS)
def trig_round_trip(spark, folder):
    return round_trip(spark, folder, "trig")


@query(NATIONS)
def jsonld_round_trip(spark, folder):
    return round_trip(spark, folder, "jsonld")


@query(NATIONS)
def ntriples_round_trip(spark, folder):
    return round_trip(spark, folder, "nt")


ODD = "chr(10) || 'a\"b\\\\c' || chr(9) || chr(13) || chr(8) || chr(12) || '''' || chr(128512) || '\\\\u0041 '"


@query(f"SELECT 'urn:d:nation:' || n_nationkey AS s, {ODD.replace(chr(92) * 2, chr(92))} || n_name AS v FROM nation")
def rdf_escapes(spark, folder):
    """Texts with everything that is escaped come back as they were."""
    odd = F.lit("\na\"b\\c\t\r\b\f'\U0001f600\\u0041 ")
    rows = store(spark, folder).source(D + "n_name").withColumn("o", terms.text(F.concat(odd, F.col("o.str")))).select(*COLS)
    scratch = Scratch(spark, "escapes-query")
    rdf.write(rows, f"{scratch.root}/nt", "nt")
    return rdf.read(spark, f"{scratch.root}/nt", "nt").select("s", F.col("o.str").alias("v"))


@query("SELECT '<< <urn:d:supplier:' || s_suppkey || '> <urn:d:s_nationkey> <urn:d:nation:' || s_nationkey || '> >> <urn:d:since> \"' || s_suppkey || '\"^^<http://www.w3.org/2001/XMLSchema#integer> .' AS value FROM supplier")
def star_export(spark, folder):
    """Annotations of edges as statements about quoted triples, written and read as lines."""
    e = geography(spark, folder, "star")
    edges = e.store.live().where(F.col("p") == D + "s_nationkey")
    e.store.commit(annotations=edges.select("edge_id", "g", F.lit(D + "since").alias("p"), terms.integer(F.regexp_extract("s", r"(\d+)$", 1).cast("bigint")).alias("o")))
    out = f"{Scratch(spark, 'star-out').root}/nts"
    e.export(out, "nts", predicates=[D + "s_nationkey"])
    return spark.read.text(out).where(F.startswith("value", F.lit("<<")))


@query("SELECT 'nations' AS what, count(*) AS n FROM nation UNION ALL SELECT 'graph', count(*) FROM nation UNION ALL SELECT 'subject', 3 UNION ALL SELECT 'malformed', 1")
def import_and_export(spark, folder):
    """A file read with a bad line skipped and listed; exports of a type, a graph and a subject read back."""
    scratch = Scratch(spark, "import-query")
    names = store(spark, folder).source(D + "n_name").select(*COLS)
    lines = rdf.lines(names).unionByName(constant(spark, [("no triple",)], "value string"))
    lines.write.text(f"{scratch.root}/in")
    e = geography(spark, folder, "import")
    bad = e.malformed(f"{scratch.root}/in").count()
    e.read_rdf(f"{scratch.root}/in", "nt", graph="urn:g:in", skip_malformed=True)
    count = lambda fmt: rdf.read(spark, f"{scratch.root}/{fmt}-out", fmt).count()
    e.export(f"{scratch.root}/jsonld-out", "jsonld", graph="", predicates=[D + "n_name"], node_type=D + "Nation")
    e.export(f"{scratch.root}/nt-out", "nt", graph="urn:g:in")
    e.export(f"{scratch.root}/ttl-out", "ttl", graph="", subjects=["urn:d:nation:3"])
    return constant(spark, [("nations", count("jsonld")), ("graph", count("nt")), ("subject", count("ttl")), ("malformed", bad)], "what string, n bigint")


@query("""SELECT '{"n":{"type":"uri","value":"urn:d:nation:' || n_nationkey || '"},"name":{"type":"literal","value":"' || n_name || '"}}' AS value FROM nation""")
def results_as_json(spark, folder):
    """The bindings of a whole results document."""
    r = loaded(spark, folder).sparql("SELECT ?n ?name { ?n d:n_name ?name }").solutions
    document = json.loads("".join(rdf.results_document(r.df, ["n", "name"])))
    assert document["head"] == {"vars": ["n", "name"]}
    return constant(spark, [(json.dumps(b, separators=(",", ":")),) for b in document["results"]["bindings"]], "value string")


@query("SELECT n_name AS name, 'urn:d:nation:' || n_nationkey AS n FROM nation")
def results_as_csv(spark, folder):
    r = loaded(spark, folder).sparql("SELECT ?n ?name { ?n d:n_name ?name }").solutions
    out = f"{Scratch(spark, 'csv-query').root}/csv"
    rdf.results_csv(r.df, ["n", "name"], out)
    return spark.read.csv(out, header=True)


# --- writes -----------------------------------------------------------------------------------------------


@query("""SELECT 'urn:d:supplier:' || s_suppkey AS s, CASE WHEN s_suppkey % 3 = 0 THEN 'yes' END AS note FROM supplier WHERE s_suppkey % 2 = 1""")
def apply_changes_with_annotations(spark, folder):
    """Relations retracted from whatever graph has them, others annotated, in one commit."""
    e = geography(spark, folder, "changes")
    edges = e.store.live().where(F.col("p") == D + "s_nationkey")
    number = F.regexp_extract("s", r"(\d+)$", 1).cast("bigint")
    notes = edges.where(number % 3 == 0).select("edge_id", "g", F.lit(D + "checked").alias("p"), terms.text(F.lit("yes")).alias("o"))
    e.store.apply_changes(None, None, annotations=notes, everywhere=edges.where(number % 2 == 0).select("s", "p", "o"))
    return e.cypher("MATCH (s)-[r:s_nationkey]->(n) RETURN s, r.checked AS note")


@query("SELECT 'urn:x' AS s, '2020' AS since")
def insert_with_annotations(spark, folder):
    e = Engine(spark, fresh(spark, "insert"), Vocabulary(D, dict(PREFIXES)))
    e.insert([("", "urn:x", D + "knows", U("urn:y")), ("", "urn:x", D + "name", Value("S", "X"))], annotations=[(0, D + "since", Value("I", 2020))])
    return e.cypher("MATCH (s)-[r:knows]->(o) WHERE r.since >= 2000 RETURN s, r.since AS since")


@query("SELECT 'urn:d:nation:' || n_nationkey AS s FROM nation WHERE n_nationkey <> 4")
def delete_triples(spark, folder):
    e = geography(spark, folder, "delete-triples")
    e.store.delete("urn:d:nation:4", D + "n_name")
    return e.snapshot().scan(p=P("n_name")).select("s")


@query(f"SELECT g, count(*) AS quads, CASE g WHEN '' THEN '{{}}' ELSE '{{}}' END AS metadata FROM {GRAPHS} GROUP BY g UNION ALL SELECT 'urn:g:new', 0, '{{\"title\": \"New\"}}'")
def graphs_listed(spark, folder):
    """Graphs with quads, and one that was only created; one that was dropped again is not there."""
    e = graph_store(spark, folder, "graphs")
    e.store.create_graph("urn:g:new", title="New")
    e.store.create_graph("urn:g:gone")
    e.store.drop_graph("urn:g:gone")
    return e.store.graphs().select("g", "quads", "metadata")


@query(f"SELECT g, count(*) AS n FROM {GRAPHS} WHERE g IN ('', 'urn:g:BUILDING') GROUP BY g")
def access_stored(spark, folder):
    """Grants and groups as they stand after grants, a revocation and a change of group."""
    st = graph_store(spark, folder, "grants").store
    st.grant("ann", "urn:g:MACHINERY", "read")
    st.grant("team", "urn:g:BUILDING", "write")
    st.grant("old", "urn:g:AUTOMOBILE", "admin")
    st.add_to_group("ann", "team")
    st.add_to_group("ann", "old")
    st.remove_from_group("ann", "old")
    st.revoke("ann", "urn:g:MACHINERY")
    return counted(access.visible_quads(st.live(), st.grants(), st.members(), "ann"), "g")


@query("SELECT 'views' AS namespace, 'a' AS node, 7 AS value UNION ALL SELECT 'views', 'b', -1")
def counters_stored(spark, folder):
    st = fresh(spark, "counters")
    st.increment([("views", "a", 3), ("views", "b", -1)])
    st.increment([("views", "a", 4)])
    return st.counters().withColumn("value", F.col("value").cast("int"))


# --- types, inference, shapes --------------------------------------------------------------------------------


@query("SELECT 'urn:d:Customer' AS name, 'bal,nick' AS fields, 'urn:d:livesIn' AS edges UNION ALL SELECT 'urn:d:Place', '', ''")
def types_registered(spark, folder):
    """Types stored and read back, with inherited fields and the predicates between two of them."""
    e = Engine(spark, fresh(spark, "types"))
    r = ontology.Registry()
    r.register_node(ontology.NodeType(D + "Agent", {D + "nick": ontology.Field("text", True)}))
    r.register_node(ontology.NodeType(D + "Customer", {D + "bal": ontology.Field("float")}, (D + "Agent",)))
    r.register_node(ontology.NodeType(D + "Place"))
    r.register_edge(ontology.EdgeType(D + "livesIn", D + "Agent", D + "Place"))
    e.register(r)
    back = e.registered()
    short = lambda names: ",".join(sorted(n[len(D) :] for n in names))
    rows = [(n, short(back.fields(n)), ",".join(back.predicates_between(n, D + "Place"))) for n in (D + "Customer", D + "Place")]
    return constant(spark, rows, "name string, fields string, edges string")


@query(OWL_COUNTS.replace("count(*) FROM customer)", "count(*) FROM customer WHERE c_custkey % 10 <> 0)"))
def inference_from_log(spark, folder):
    """Inference once, then every tenth customer leaves and half of those that came late arrive: the second
    run works from the change log."""
    e = Engine(spark, fresh(spark, "inference"))
    quads = Scratch(spark, "inference-input").save(company(spark, folder), "quads")
    number = F.regexp_extract("s", r"(\d+)$", 1).cast("bigint")
    mine = F.col("p") == D + "c_in"
    e.store.commit(quads.where(~mine | (number % 10 != 1)).select(*COLS))
    e.materialize()
    e.store.commit(quads.where(mine & (number % 10 == 1)).select(*COLS), quads.where(mine & (number % 10 == 0)).select(*COLS))
    e.materialize()
    live = e.store.live()
    assert e.materialize() == (0, 0)
    return counted(live.where(F.col("g").startswith(INFERRED)), "p")


@query("SELECT 'urn:d:customer:' || c_custkey AS s FROM customer")
def owl_schema_graphs(spark, folder):
    """Only the schema of the named graphs counts."""
    c = table(spark, folder, "customer")
    typed = c.select(F.lit("").alias("g"), iri("customer", F.col("c_custkey")).alias("s"), F.lit(TYPE).alias("p"), terms.node(F.lit(D + "Customer")).alias("o"))
    rules = rdf.quads_of(spark, [("urn:g:schema", D + "Customer", RDFS + "subClassOf", U(D + "Agent")), ("urn:g:other", D + "Customer", RDFS + "subClassOf", U(D + "Ghost"))]).select(*COLS)
    return owl.materialize(typed.unionByName(rules), ["urn:g:schema"]).where("o.kind = 'U' AND s LIKE 'urn:d:customer:%'").select("s")


@query("SELECT 'urn:d:partOf' AS p, count(*) AS n FROM nation")
def owl_large_schema(spark, folder):
    """The distributed rounds, which schemas beyond the driver's share go through."""
    n = table(spark, folder, "nation")
    facts = n.select(F.lit("").alias("g"), iri("nation", F.col("n_nationkey")).alias("s"), F.lit(D + "n_in").alias("p"), terms.node(iri("region", F.col("n_regionkey"))).alias("o"))
    rules = rdf.quads_of(spark, [("", D + "n_in", RDFS + "subPropertyOf", U(D + "partOf")), ("", D + "partOf", TYPE, U(OWL + "TransitiveProperty"))]).select(*COLS)
    scratch = Scratch(spark, "owl-large")
    base = facts.unionByName(rules)
    asserted = scratch.save(owl._instance(owl._facts(base)).dropDuplicates(owl.KEYS), "asserted")
    rules = owl.schema(base, scratch)
    found = owl._fixpoint(asserted, [asserted], lambda new, known: owl.consequences(new, known, rules), scratch, "facts")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return counted(out, "p")


NODE_SHAPES = """@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix d: <urn:d:> .
d:NationShape sh:targetClass d:Nation ; sh:property [ sh:path d:n_regionkey ; sh:node d:RegionShape ] .
d:RegionShape sh:property [ sh:path d:r_name ; sh:minCount 1 ; sh:pattern "^A" ] .
d:NameShape sh:targetSubjectsOf d:r_name ; sh:property [ sh:path d:r_name ; sh:minLength 5 ] .
d:OneShape sh:targetNode <urn:d:region:1> ; sh:property [ sh:path d:missing ; sh:minCount 1 ] .
d:UsedShape sh:targetObjectsOf d:n_regionkey ; sh:property [ sh:path [ sh:inversePath d:n_regionkey ] ; sh:minCount 1 ] ."""


@query("""SELECT 'urn:d:NationShape' AS shape, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey WHERE NOT starts_with(r_name, 'A') HAVING count(*) > 0
UNION ALL SELECT 'urn:d:NameShape', count(*) FROM region WHERE length(r_name) < 5 HAVING count(*) > 0 UNION ALL SELECT 'urn:d:OneShape', 1""")
def shacl_nodes_and_targets(spark, folder):
    """Shapes of nodes at the end of a path, and all four kinds of target."""
    quads = quads_of_tables(spark, folder, "region", "nation").select(*COLS)
    shape_of = {s.properties[0]: s.iri for s in shacl.shapes(rdf.parse_turtle(NODE_SHAPES)).values() if s.properties and s.targets}
    names = F.create_map(*[F.lit(x) for kv in shape_of.items() for x in kv])
    found = shacl.validate(rdf.parse_turtle(NODE_SHAPES), quads)
    return counted(found.select(names[F.col("shape")].alias("shape")), "shape")


@query("SELECT 'urn:d:nation:' || n_nationkey AS focus FROM nation WHERE n_nationkey % 3 = 0")
def shacl_overlay(spark, folder):
    """Shapes over quads with changes laid on top: names that a proposal takes away are missed, and only there."""
    quads = quads_of_tables(spark, folder, "nation").select(*COLS)
    shapes = "@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix d: <urn:d:> . d:S sh:targetClass d:Nation ; sh:property [ sh:path d:n_name ; sh:minCount 1 ] ; sh:property [ sh:path d:never ; sh:maxCount 0 ] ."
    gone = quads.where((F.col("p") == D + "n_name") & (F.regexp_extract("s", r"(\d+)$", 1).cast("bigint") % 3 == 0))
    return shacl.validate(rdf.parse_turtle(shapes), quads, retracts=gone).select("focus")


@query("SELECT 'focusNode' AS p, count(*) AS n FROM nation UNION ALL SELECT 'sourceShape', count(*) FROM nation")
def shacl_report_triples(spark, folder):
    quads = quads_of_tables(spark, folder, "nation").select(*COLS)
    shapes = "@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix d: <urn:d:> . d:S sh:targetClass d:Nation ; sh:property [ sh:path d:motto ; sh:minCount 1 ] ."
    rows = shacl.report_triples(shacl.validate(rdf.parse_turtle(shapes), quads))
    return counted(rows.select(F.regexp_extract("p", r"#(\w+)$", 1).alias("p")).where("p IN ('focusNode', 'sourceShape')"), "p")


# --- vectors ---------------------------------------------------------------------------------------------------


def embedded(spark, folder, name: str) -> Engine:
    """A store with every embedding, its label as type, and links from one vector to the next of its label."""
    rows = Scratch(spark, f"{name}-rows").save(space(spark, folder), "rows")
    e = Engine(spark, fresh(spark, name), Vocabulary(D, dict(PREFIXES)))
    typed = rows.select(F.lit("").alias("g"), F.col("node").alias("s"), F.lit(TYPE).alias("p"), terms.node(F.concat(F.lit(D + "L"), F.col("label").cast("string"))).alias("o"))
    e.store.commit(typed, vectors=rows.select("space", "node", "vec"))
    return e


EXACT = "list_dot_product(a.e, q.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(q.e, q.e)))"
VECS = "(SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"


@query(f"SELECT 'urn:d:vec:' || a.vec_id AS node, round({EXACT}, 6) AS score FROM {VECS} a, {VECS} q WHERE q.vec_id = 0 AND a.label = 3 ORDER BY {EXACT} DESC, 1 LIMIT 10")
def vector_filtered_by_type(spark, folder):
    e = embedded(spark, folder, "vector-type")
    return e.vector_search("emb", first_vector(spark, folder), 10, node_type=D + "L3", exact=True).withColumn("score", F.round("score", 6))


@query(f"SELECT 'urn:d:vec:' || a.vec_id AS node FROM {VECS} a, {VECS} q WHERE q.vec_id = 0 AND a.vec_id % 2 = 1 ORDER BY {EXACT} DESC, 1 LIMIT 10")
def vector_visible_candidates(spark, folder):
    """Nodes of a pattern's variable, of which those of closed quads are not seen."""
    e = embedded(spark, folder, "vector-seen")
    even = e.store.live().where(F.regexp_extract("s", r"(\d+)$", 1).cast("bigint") % 2 == 0).select(*COLS)
    e.store.commit(retracts=even)
    rows = e.vector_search("emb", first_vector(spark, folder), 10, candidates=([Pattern(V("v"), U(TYPE), V("t"))], "v"), exact=True)
    return rows.select("node")


@query("SELECT true AS recall_ok, 40 AS queries, 0 AS missing")
def vector_index_recall(spark, folder):
    """The stored index against the exact search: 0.9 of the ten nearest or more, over 40 queries."""
    st = fresh(spark, "vector-index")
    rows = Scratch(spark, "vector-index-rows").save(space(spark, folder), "rows")
    st.commit(vectors=rows.select("space", "node", "vec"))
    st.index_vectors("emb")
    picked = rows.orderBy(F.xxhash64("node"), "node").limit(40).select(F.col("node").alias("query"), "vec")
    truth: dict[str, set] = {}
    for r in vectors.batch_top_k(rows, picked, 10).collect():
        truth.setdefault(r["query"], set()).add(r["node"])
    hits = missing = 0
    for r in picked.collect():
        got = {x.node for x in st.nearest("emb", list(r["vec"]), 10).collect()}
        hits, missing = hits + len(got & truth[r["query"]]), missing + 10 - len(got)
    return constant(spark, [(hits >= 0.9 * 10 * len(truth), len(truth), missing)], "recall_ok boolean, queries int, missing int")


@query("SELECT 'urn:d:new' AS node, 1 AS n")
def vector_index_updates(spark, folder):
    """A vector that was committed after the index was built is found beside it."""
    st = fresh(spark, "vector-late")
    st.commit(vectors=space(spark, folder).select("space", "node", "vec"))
    st.index_vectors("emb")
    q = first_vector(spark, folder)
    st.commit(vectors=constant(spark, [("emb", "urn:d:new", [x * 2 for x in q])], "space string, node string, vec array<double>"))
    best = [r.node for r in st.nearest("emb", q, 2).collect()]
    return constant(spark, [(n, 1) for n in best if n == "urn:d:new"], "node string, n int")


# --- the feed ---------------------------------------------------------------------------------------------------


@query("SELECT 'out of range' AS what, 1 AS n UNION ALL SELECT 'left', count(*) FROM nation")
def feed_pruned(spark, folder):
    """After pruning the feed begins later, and a reader that asks for more is told."""
    st = fresh(spark, "pruned")
    names = store(spark, folder).source(D + "n_name").select(*COLS)
    first = st.commit(store(spark, folder).source(D + "r_name").select(*COLS))
    st.commit(names)
    st.prune_changes(first)
    try:
        changes.batch(st, 0)
        told = 0
    except changes.OutOfRange:
        told = 1
    return constant(spark, [("out of range", told), ("left", changes.batch(st).count())], "what string, n bigint")


@query("SELECT 'urn:d:' || CASE WHEN c_custkey % 4 = 0 THEN 'Gone' ELSE 'Customer' END AS type, count(*) AS n FROM customer WHERE c_custkey % 8 <> 0 GROUP BY 1")
def type_index_from_feed(spark, folder):
    """The type index follows the feed over three commits, in two steps."""
    st = fresh(spark, "types-feed")
    index = changes.TypeIndex(st, f"{st.path}/type-index")
    c = table(spark, folder, "customer")
    typed = lambda df, t: df.select(F.lit("").alias("g"), iri("customer", F.col("c_custkey")).alias("s"), F.lit(TYPE).alias("p"), terms.node(F.lit(D + t)).alias("o"))
    st.commit(typed(c, "Customer"))
    index.refresh()
    st.commit(typed(c.where("c_custkey % 4 = 0"), "Gone"), typed(c.where("c_custkey % 4 = 0"), "Customer"))
    st.commit(retracts=typed(c.where("c_custkey % 8 = 0"), "Gone"))
    index.refresh()
    return counted(index.read(), "type")


@query("SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS start, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1, 2")
def event_windows(spark, folder):
    """Events in windows of an hour, by the code that a stream with a watermark runs."""
    ev = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return changes.event_windows(ev).select("event_type", F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT 'urn:b:q' AS iri, 'q' AS name UNION ALL SELECT 'http://x/p', 'x:p' UNION ALL SELECT 'urn:other', 'urn:other'")
def vocabulary(spark, folder):
    v = Vocabulary("urn:b:")
    v.put("x", "http://x/")
    v.put("y", "http://y/")
    v.remove("y")
    rows = [(v.expand(n), v.compact(v.expand(n))) for n in ("q", "x:p", "urn:other")]
    return constant(spark, rows, "iri string, name string")


