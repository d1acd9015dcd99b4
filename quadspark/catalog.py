"""The library's queries over the test tables, one or more an operator, each with its SQL.

Queries run over whole tables through the operators; the SQL says the same of the relational tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadspark.functions import terms
from quadspark.functions.terms import OWL, RDF_TYPE, RDFS, Value
from quadspark.operators import access, ontology, owl, shacl, snapshot, vectors
from quadspark.operators.snapshot import END, Snapshot
from quadspark.operators.store import Store
from quadspark.plans.build import Builder, Solutions
from quadspark.plans.cypher import Cypher
from quadspark.plans.patterns import ANY, Graph, Pattern, Query, Rule, Var, Vocabulary
from quadspark.plans.sparql import Sparql
from quadspark.scratch import Scratch
from quadspark.sources import rdf
from quadspark.sources.tables import BASE, TableStore, event_versions, iri
from quadspark.streaming import changes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

D = BASE
U = lambda x: Value("U", x)
P = lambda name: U(D + name)
PREFIXES = {"d": D, "rdfs": RDFS}


def query(sql: str | None = None):
    """Registers a function of (spark, folder) with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def store(spark: SparkSession, folder: str, notes: bool = False) -> Snapshot:
    tables = TableStore(spark, folder)
    return tables.snapshot(tables.lineitem_annotations() if notes else None)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(rows: Solutions | DataFrame, **columns: str) -> DataFrame:
    """Columns from variables: name = variable, or variable:n for its number, variable:i for its integer."""
    df = rows.df if isinstance(rows, Solutions) else rows
    out = []
    for name, spec in columns.items():
        var, _, how = spec.partition(":")
        t = F.col(f"`{var}`")
        out.append((terms.number(t) if how == "n" else t["int"] if how == "i" else t["bool"] if how == "b" else terms.plain(t)).alias(name))
    return df.select(*out)


def cypher(spark, folder, text: str, params=None, notes=False, vectors_of=None) -> DataFrame:
    return Cypher(store(spark, folder, notes), spark, Vocabulary(D), vectors_of).run(text, params)


def sparql(spark, folder, text: str, notes=False):
    return Sparql(store(spark, folder, notes), spark, PREFIXES).run(text)


def conjunction(spark, folder, *patterns: Pattern, notes=False) -> Solutions:
    return Builder(store(spark, folder, notes), spark).conjunction(list(patterns))


V = Var
NODE = lambda t, k: f"'urn:d:{t}:' || {k}"

# --- scans --------------------------------------------------------------------------------------


@query("""SELECT 'urn:d:n_name' AS p, n_name AS o FROM nation WHERE n_nationkey = 3
UNION ALL SELECT 'urn:d:n_regionkey', 'urn:d:region:' || n_regionkey FROM nation WHERE n_nationkey = 3
UNION ALL SELECT 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'urn:d:Nation' FROM nation WHERE n_nationkey = 3""")
def scan_subject(spark, folder):
    rows = store(spark, folder).scan(s=U("urn:d:nation:3"))
    return rows.select("p", terms.plain(F.col("o")).alias("o"))


@query("SELECT o_totalprice AS v FROM orders WHERE o_orderkey = 7")
def scan_subject_predicate(spark, folder):
    return store(spark, folder).scan(s=U("urn:d:orders:7"), p=P("o_totalprice")).select(F.col("o.dbl").alias("v"))


@query("SELECT 'urn:d:customer:' || c_custkey AS s, c_mktsegment AS v FROM customer WHERE c_mktsegment IS NOT NULL")
def scan_predicate(spark, folder):
    return store(spark, folder).scan(p=P("c_mktsegment")).select("s", F.col("o.str").alias("v"))


@query("SELECT 'urn:d:customer:' || c_custkey AS s FROM customer WHERE c_mktsegment = 'BUILDING'")
def scan_predicate_object(spark, folder):
    return store(spark, folder).scan(p=P("c_mktsegment"), o=Value("S", "BUILDING")).select("s")


@query("""SELECT 'urn:d:customer:' || c_custkey AS s, 'urn:d:c_nationkey' AS p FROM customer WHERE c_nationkey = 3
UNION ALL SELECT 'urn:d:supplier:' || s_suppkey, 'urn:d:s_nationkey' FROM supplier WHERE s_nationkey = 3""")
def scan_object(spark, folder):
    return store(spark, folder).scan(o=U("urn:d:nation:3")).select("s", "p")


@query("SELECT 'urn:d:o_custkey' AS p, count(*) AS n FROM orders WHERE o_custkey = 3 AND o_orderkey = (SELECT min(o_orderkey) FROM orders WHERE o_custkey = 3) GROUP BY 1")
def scan_subject_object(spark, folder):
    first = table(spark, folder, "orders").where("o_custkey = 3").agg(F.min("o_orderkey")).first()[0]
    rows = store(spark, folder).scan(s=U(f"urn:d:orders:{first}"), o=U("urn:d:customer:3"))
    return rows.groupBy("p").agg(F.count(F.lit(1)).alias("n"))


#: Tables and their columns that are predicates, for SQL over every table.
WHOLE = {
    "region": "r_name", "nation": "n_name n_regionkey", "customer": "c_name c_nationkey c_acctbal c_mktsegment", "supplier": "s_name s_nationkey s_acctbal", "part": "p_name p_brand p_type p_size p_retailprice",
    "orders": "o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority", "lineitem": "l_orderkey l_partkey l_suppkey l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate",
    "documents": "text lang source n_chars", "labels": "quality toxic", "pages": "url html", "conversations": "role text",
}
WHOLE_SQL = "SELECT p, CAST(sum(n) AS BIGINT) AS n FROM (" + " UNION ALL ".join(
    f"SELECT '{p}' AS p, count({c}) AS n FROM {t}" for t, columns in WHOLE.items() for p, c in [*((D + c, c) for c in columns.split()), (RDF_TYPE, "*")]) + ") GROUP BY p"


@query(WHOLE_SQL)
def scan_full(spark, folder):
    """The full scan over every table."""
    return store(spark, folder).scan().groupBy("p").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'urn:d:part:' || p_partkey AS s, p_name AS v FROM part WHERE contains(lower(p_name), 'red')")
def text_search(spark, folder):
    return snapshot.text_search(store(spark, folder).scan(p=P("p_name")), "RED").select("s", F.col("o.str").alias("v"))


GRAPHS = "(SELECT 'urn:g:' || c_mktsegment AS g, 'urn:d:customer:' || c_custkey AS s, c_nationkey AS k FROM customer UNION ALL SELECT '', 'urn:d:customer:' || c_custkey, c_nationkey FROM customer WHERE c_custkey % 2 = 0)"


def segment_graphs(spark, folder) -> DataFrame:
    """Customers' nations in a graph a segment, and those of even keys in the default graph too."""
    df = table(spark, folder, "customer")
    row = lambda g, d: d.select(g.alias("g"), iri("customer", F.col("c_custkey")).alias("s"), F.lit(D + "c_nationkey").alias("p"), terms.node(iri("nation", F.col("c_nationkey"))).alias("o"))
    quads = row(F.concat(F.lit("urn:g:"), F.col("c_mktsegment")), df).unionByName(row(F.lit(""), df.where("c_custkey % 2 = 0")))
    return rdf.with_edges(quads)


@query(f"SELECT s, min(g) AS g, count(*) AS n FROM {GRAPHS} GROUP BY s")
def scan_union_of_graphs(spark, folder):
    rows = Snapshot.of(segment_graphs(spark, folder)).scan()
    every = segment_graphs(spark, folder).groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("s", "g").join(every, "s")


@query(f"SELECT g, count(*) AS n FROM {GRAPHS} WHERE g <> '' GROUP BY g")
def graph_variable(spark, folder):
    b = Builder(Snapshot.of(segment_graphs(spark, folder)), spark)
    rows = b.scan(Pattern(ANY, P("c_nationkey"), ANY, Graph("named", var="g")))
    return texts(rows, g="g").groupBy("g").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT s FROM {GRAPHS} WHERE g = 'urn:g:BUILDING'")
def graph_scan(spark, folder):
    return Snapshot.of(segment_graphs(spark, folder)).scan(graph=Graph("one", ("urn:g:BUILDING",))).select("s")


@query(f"SELECT DISTINCT s FROM {GRAPHS} WHERE g IN ('urn:g:BUILDING', '')")
def graph_set_merge(spark, folder):
    return Snapshot.of(segment_graphs(spark, folder)).scan(graph=Graph("set", ("urn:g:BUILDING", ""))).select("s")


@query(f"SELECT DISTINCT g FROM {GRAPHS} WHERE s = 'urn:d:customer:4'")
def subject_graphs(spark, folder):
    return Snapshot.of(segment_graphs(spark, folder)).graphs_of("urn:d:customer:4").select("g")


@query("SELECT 'nation-of' AS label, 'urn:d:nation:' || c_nationkey AS s, 'urn:d:customer:' || c_custkey AS o FROM customer")
def view_projection(spark, folder):
    rows = snapshot.view(store(spark, folder).scan(p=P("c_nationkey")), {D + "c_nationkey": ("nation-of", True)})
    return rows.select("label", "s", F.col("o.str").alias("o"))


# --- bitemporal ---------------------------------------------------------------------------------

VERSIONS = "(SELECT 'urn:d:user:' || user_id AS s, 'urn:d:' || event_type AS p, value AS v, epoch_us(ts) AS vt_start, epoch_us(ts) + event_id AS tt FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL AND ts IS NOT NULL)"
AS_OF = 1_705_000_000_000_000


def replaced_versions(spark, folder) -> DataFrame:
    """Each event replaces the user's value of its type: the version before ends where it starts."""
    v = event_versions(table(spark, folder, "events"))
    after = F.lead("vt_start").over(Window.partitionBy("s", "p").orderBy("vt_start", "tt"))
    return v.withColumn("vt_end", F.coalesce(after, F.lit(END)))


@query(f"""SELECT s, p, v FROM (SELECT *, coalesce(lead(vt_start) OVER (PARTITION BY s, p ORDER BY vt_start, tt), 9223372036854775807) AS e FROM {VERSIONS})
WHERE vt_start <= {AS_OF} AND e > {AS_OF}""")
def snapshot_as_of(spark, folder):
    live = snapshot.resolve(replaced_versions(spark, folder), vt=AS_OF)
    return live.select("s", "p", F.col("o.dbl").alias("v"))


@query(f"""SELECT count(*) AS n, round(sum(v), 2) AS total FROM (SELECT *, coalesce(lead(vt_start) OVER (PARTITION BY s, p ORDER BY vt_start, tt), 9223372036854775807) AS e FROM {VERSIONS})
WHERE e = 9223372036854775807""")
def snapshot_now(spark, folder):
    return snapshot.resolve(replaced_versions(spark, folder)).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o.dbl"), 2).alias("total"))


@query(f"""SELECT count(*) AS n, round(sum(v), 2) AS total FROM (SELECT *, row_number() OVER (PARTITION BY s, p, v ORDER BY vt_start DESC, tt DESC) AS r FROM {VERSIONS} WHERE tt <= {AS_OF} AND vt_start <= {AS_OF}) WHERE r = 1""")
def snapshot_known_at(spark, folder):
    live = snapshot.resolve(event_versions(table(spark, folder, "events")), vt=AS_OF, tt=AS_OF)
    return live.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o.dbl"), 2).alias("total"))


@query(f"SELECT v, vt_start FROM {VERSIONS} WHERE s = 'urn:d:user:8' AND p = 'urn:d:click'")
def property_history(spark, folder):
    rows = snapshot.history(event_versions(table(spark, folder, "events")), "urn:d:user:8", D + "click", limit=None)
    return rows.select(F.col("o.dbl").alias("v"), "vt_start")


@query(f"""SELECT s, p, count(*) AS n FROM (SELECT *, max(CASE WHEN tt < {AS_OF} THEN tt END) OVER (PARTITION BY s, p, v, vt_start) AS m,
coalesce(lead(vt_start) OVER (PARTITION BY s, p ORDER BY vt_start, tt), 9223372036854775807) AS e FROM {VERSIONS}) WHERE (m IS NULL OR tt >= m) AND e >= {AS_OF} GROUP BY s, p""")
def retention(spark, folder):
    kept = snapshot.retain(replaced_versions(spark, folder).withColumn("g", F.concat(F.lit("urn:t:"), F.col("tt").cast("string"))), AS_OF, AS_OF)
    return kept.groupBy("s", "p").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 'urn:d:user:' || user_id AS edge, round(arg_max(value, event_id), 4) AS v FROM events WHERE event_type = 'view' GROUP BY user_id""")
def latest_annotation(spark, folder):
    ev = table(spark, folder, "events").where("event_type = 'view'")
    notes = ev.select(iri("user", F.col("user_id")).alias("edge_id"), F.lit("").alias("g"), F.lit(D + "view").alias("p"), terms.double(F.col("value")).alias("o"), F.col("event_id").alias("tt"))
    return snapshot.latest_annotations(notes).select(F.col("edge_id").alias("edge"), F.round("o.dbl", 4).alias("v"))


# --- patterns and rules -----------------------------------------------------------------------------


@query("SELECT 'urn:d:orders:' || o_orderkey AS o, 'urn:d:nation:' || c_nationkey AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def join_chain(spark, folder):
    rows = conjunction(spark, folder, Pattern(V("o"), P("o_custkey"), V("c")), Pattern(V("c"), P("c_nationkey"), V("n")), Pattern(V("c"), P("c_mktsegment"), Value("S", "BUILDING")))
    return texts(rows, o="o", n="n")


@query("""SELECT 'urn:d:region:' || r_regionkey AS r, 'urn:d:nation:' || n_nationkey AS n, count(*) AS c FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE o_orderstatus = 'F' GROUP BY 1, 2""")
def join_five(spark, folder):
    rows = conjunction(
        spark, folder, Pattern(V("o"), P("o_orderstatus"), Value("S", "F")), Pattern(V("o"), P("o_custkey"), V("c")), Pattern(V("c"), P("c_nationkey"), V("n")),
        Pattern(V("n"), P("n_regionkey"), V("r")), Pattern(V("r"), U(RDF_TYPE), U("urn:d:Region")),
    )
    return texts(rows, r="r", n="n").groupBy("r", "n").agg(F.count(F.lit(1)).alias("c"))


@query("SELECT 'urn:d:customer:' || c_custkey AS c, 'urn:d:supplier:' || s_suppkey AS s FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE c_mktsegment = 'MACHINERY'")
def join_star(spark, folder):
    rows = conjunction(spark, folder, Pattern(V("c"), P("c_nationkey"), V("n")), Pattern(V("s"), P("s_nationkey"), V("n")), Pattern(V("c"), P("c_mktsegment"), Value("S", "MACHINERY")))
    return texts(rows, c="c", s="s")


@query("SELECT 'urn:d:part:' || a.p_partkey AS a, 'urn:d:part:' || b.p_partkey AS b FROM part a JOIN part b ON a.p_retailprice = b.p_retailprice AND a.p_size = b.p_size AND a.p_brand = b.p_brand")
def join_on_values(spark, folder):
    p = [Pattern(V(x), P(q), V(v)) for x in ("a", "b") for q, v in (("p_retailprice", "r"), ("p_size", "z"), ("p_brand", "br"))]
    return texts(conjunction(spark, folder, *p), a="a", b="b")


EDGES = "(SELECT 'urn:d:customer:' || c_custkey AS s, 'urn:d:customer:' || CAST(floor(c_custkey / 2) AS BIGINT) AS o FROM customer)"


def referral_quads(spark, folder) -> DataFrame:
    """Every customer refers to the one of half its key; customer 0 to itself."""
    df = table(spark, folder, "customer").select(iri("customer", F.col("c_custkey")).alias("s"), iri("customer", F.floor(F.col("c_custkey") / 2)).alias("o"))
    return df.select(F.lit("").alias("g"), "s", F.lit(D + "refers").alias("p"), terms.node(F.col("o")).alias("o"), F.lit(None).cast("string").alias("edge_id"))


def referrals(spark, folder) -> Builder:
    return Builder(Snapshot(lambda p: referral_quads(spark, folder), one_graph=True), spark)


@query(f"SELECT s AS x FROM {EDGES} WHERE s = o")
def join_repeated_variable(spark, folder):
    return texts(referrals(spark, folder).scan(Pattern(V("x"), P("refers"), V("x"))), x="x")


@query(WHOLE_SQL)
def predicate_variable(spark, folder):
    """A pattern of three variables over every table and subject."""
    rows = Builder(store(spark, folder), spark).scan(Pattern(V("s"), V("p"), V("o")))
    return texts(rows, p="p").groupBy("p").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'urn:d:orders:' || o_orderkey AS o, o_orderstatus AS st FROM orders WHERE o_custkey IN (1, 2, 4)")
def seeded_query(spark, folder):
    seed = spark.createDataFrame([(f"urn:d:customer:{k}",) for k in (1, 2, 4)], "c string").select(terms.node(F.col("c")).alias("c"))
    rows = Builder(store(spark, folder), spark).conjunction([Pattern(V("o"), P("o_custkey"), V("c")), Pattern(V("o"), P("o_orderstatus"), V("st"))], Solutions(seed, ("c",), frozenset("c")))
    return texts(rows, o="o", st="st")


@query(f"""WITH e AS {EDGES}, r1 AS (SELECT DISTINCT s, o FROM e), r2 AS (SELECT DISTINCT r1.s, e.o FROM r1 JOIN e ON r1.o = e.s), r3 AS (SELECT DISTINCT r2.s, e.o FROM r2 JOIN e ON r2.o = e.s)
SELECT s, o FROM r1 UNION SELECT s, o FROM r2 UNION SELECT s, o FROM r3""")
def path_bounded(spark, folder):
    return texts(referrals(spark, folder).scan(Pattern(V("s"), P("refers"), V("o"), hops=(1, 3))), s="s", o="o")


@query(f"""WITH e AS {EDGES}, r1 AS (SELECT DISTINCT s, o FROM e), r2 AS (SELECT DISTINCT r1.s, e.o FROM r1 JOIN e ON r1.o = e.s), r3 AS (SELECT DISTINCT r2.s, e.o FROM r2 JOIN e ON r2.o = e.s)
SELECT s, o FROM r2 UNION SELECT s, o FROM r3""")
def path_least_and_most(spark, folder):
    return texts(referrals(spark, folder).scan(Pattern(V("s"), P("refers"), V("o"), hops=(2, 3))), s="s", o="o")


@query(f"WITH RECURSIVE e AS {EDGES}, r AS (SELECT s, o FROM e UNION SELECT r.s, e.o FROM r JOIN e ON r.o = e.s) SELECT s, o FROM r")
def path_closure(spark, folder):
    return texts(referrals(spark, folder).scan(Pattern(V("s"), P("refers"), V("o"), hops=(1, None))), s="s", o="o")


@query(f"WITH RECURSIVE e AS {EDGES}, r AS (SELECT s, o FROM e UNION SELECT r.s, e.o FROM r JOIN e ON r.o = e.s) SELECT o AS x FROM r WHERE s = 'urn:d:customer:1001'")
def reachable_from(spark, folder):
    return texts(referrals(spark, folder).scan(Pattern(U("urn:d:customer:1001"), P("refers"), V("x"), hops=(1, None))), x="x")


@query(f"""WITH RECURSIVE e AS {EDGES}, anc AS (SELECT s, o FROM e UNION SELECT anc.s, e.o FROM anc JOIN e ON anc.o = e.s)
SELECT a.s, count(DISTINCT b.s) AS n FROM anc a JOIN e ON a.s = e.s JOIN anc b ON b.o = e.o AND b.s <> a.s WHERE a.o = 'urn:d:customer:3' GROUP BY a.s""")
def rules_recursive(spark, folder):
    """Ancestors by rules, and from them relatives, which share the customer referred to."""
    b = referrals(spark, folder)
    rules = [
        Rule("anc", "x", "y", (Pattern(V("x"), P("refers"), V("y")),)),
        Rule("anc", "x", "z", (Pattern(V("x"), U("anc"), V("y")), Pattern(V("y"), P("refers"), V("z")))),
        Rule("rel", "x", "z", (Pattern(V("x"), P("refers"), V("y")), Pattern(V("z"), U("anc"), V("y")))),
    ]
    rows = b.query(Query([Pattern(V("x"), U("anc"), U("urn:d:customer:3")), Pattern(V("x"), U("rel"), V("z"))], rules))
    pairs = texts(rows, s="x", z="z").where("s <> z")
    return pairs.groupBy("s").agg(F.count_distinct("z").alias("n"))


# --- Cypher ----------------------------------------------------------------------------------------


@query("SELECT 'urn:d:nation:' || n_nationkey AS n, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def cypher_flagship(spark, folder):
    df = cypher(spark, folder, "MATCH (o:Orders)-[:o_custkey]->(c:Customer)-[:c_nationkey]->(n:Nation) RETURN n, count(*) AS n_orders, sum(o.o_totalprice) AS total ORDER BY n_orders DESC")
    return df.withColumn("total", F.round("total", 2))


@query("SELECT 'urn:d:customer:' || c_custkey AS c, c_name AS name FROM customer WHERE c_acctbal > 9000 AND c_name LIKE 'Customer#0000001%' AND c_mktsegment LIKE '%BUIL%'")
def cypher_where(spark, folder):
    return cypher(spark, folder, "MATCH (c:Customer) WHERE c.c_acctbal > 9000 AND c.c_name STARTS WITH 'Customer#0000001' AND c.c_mktsegment CONTAINS 'BUIL' RETURN c, c.c_name AS name")


@query("SELECT 'urn:d:customer:' || c_custkey AS c FROM customer WHERE (c_acctbal < -900 OR c_acctbal >= 9900) AND NOT c_mktsegment = 'BUILDING'")
def cypher_or_not(spark, folder):
    return cypher(spark, folder, "MATCH (c:Customer) WHERE (c.c_acctbal < -900 OR c.c_acctbal >= 9900) AND NOT c.c_mktsegment = 'BUILDING' RETURN c")


@query("SELECT 'urn:d:part:' || p_partkey AS id FROM part WHERE regexp_matches(p_name, '(red|blue) .*t$') AND p_brand <> 'Brand#4'")
def cypher_regex(spark, folder):
    return cypher(spark, folder, "MATCH (p:Part) WHERE p.p_name =~ '(red|blue) .*t$' AND p.p_brand <> 'Brand#4' RETURN id(p) AS id")


@query("SELECT count(*) AS n, 'urn:d:part:' || l_partkey AS p FROM lineitem WHERE l_quantity >= 49 AND l_discount < 0.02 GROUP BY l_partkey")
def cypher_edge_filter(spark, folder):
    return cypher(spark, folder, "MATCH (l)-[e:l_partkey]->(p) WHERE e.quantity >= 49 AND e.discount < 0.02 RETURN p, count(*) AS n", notes=True)


@query("SELECT 'urn:d:orders:' || o_orderkey AS o FROM orders WHERE o_custkey = 5 AND o_orderstatus = 'F'")
def cypher_parameters(spark, folder):
    return cypher(spark, folder, "MATCH (o:Orders {o_orderstatus: $st})-[:o_custkey]->(c:Customer {c_name: $name}) RETURN o", {"st": "F", "name": "Customer#000000005"})


@query("""SELECT c_mktsegment AS seg, count(*) AS n, round(avg(c_acctbal), 4) AS a, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer GROUP BY 1""")
def cypher_aggregates(spark, folder):
    df = cypher(spark, folder, "MATCH (c:Customer) RETURN c.c_mktsegment AS seg, count(*) AS n, avg(c.c_acctbal) AS a, min(c.c_acctbal) AS lo, max(c.c_acctbal) AS hi")
    return df.withColumn("a", F.round("a", 4))


@query("SELECT 'urn:d:orders:' || o_orderkey AS o FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 7 OFFSET 3")
def cypher_order_page(spark, folder):
    return cypher(spark, folder, "MATCH (o:Orders) RETURN o ORDER BY o.o_totalprice DESC SKIP 3 LIMIT 7")


@query("SELECT 'urn:d:customer:' || c_custkey AS c, 'urn:d:region:' || n_regionkey AS r FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 9500")
def cypher_with(spark, folder):
    return cypher(spark, folder, "MATCH (c:Customer)-[:c_nationkey]->(n:Nation)-[:n_regionkey]->(r) WITH c, r WHERE c.c_acctbal > 9500 RETURN c, r")


@query("SELECT 'urn:d:nation:' || n_nationkey AS n, to_json(list(c ORDER BY c))::VARCHAR AS cs FROM (SELECT n_nationkey, 'urn:d:supplier:' || s_suppkey AS c FROM supplier JOIN nation ON s_nationkey = n_nationkey) GROUP BY 1")
def cypher_collect(spark, folder):
    return cypher(spark, folder, "MATCH (s:Supplier)-[:s_nationkey]->(n:Nation) RETURN n, collect(s) AS cs")


# --- SPARQL ------------------------------------------------------------------------------------------


@query("SELECT r_name AS r, count(*) AS n, round(avg(c_acctbal), 4) AS a FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 0 GROUP BY r_name HAVING count(*) > 10")
def sparql_group_having(spark, folder):
    r = sparql(spark, folder, "SELECT ?r (COUNT(*) AS ?n) (AVG(?b) AS ?a) { ?c d:c_nationkey/d:n_regionkey ?g ; d:c_acctbal ?b . ?g d:r_name ?r FILTER(?b > 0) } GROUP BY ?r HAVING(COUNT(*) > 10)")
    return texts(r.solutions, r="r", n="n:i", a="a:n").withColumn("a", F.round("a", 4))


@query("SELECT 'urn:d:customer:' || c_custkey AS c, 'urn:d:orders:' || o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 400000")
def sparql_optional(spark, folder):
    r = sparql(spark, folder, "SELECT ?c ?o { ?c a d:Customer OPTIONAL { ?o d:o_custkey ?c ; d:o_totalprice ?t FILTER(?t > 400000) } }")
    return texts(r.solutions, c="c", o="o")


@query("SELECT 'urn:d:customer:' || c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def sparql_not_bound(spark, folder):
    return texts(sparql(spark, folder, "SELECT ?c { ?c a d:Customer OPTIONAL { ?o d:o_custkey ?c ; d:o_totalprice ?t FILTER(?t > 200000) } FILTER(!BOUND(?o)) }").solutions, c="c")


@query("SELECT 'urn:d:customer:' || c_custkey AS x, c_nationkey < 5 AS low FROM customer WHERE c_nationkey < 5 UNION ALL SELECT 'urn:d:supplier:' || s_suppkey, NULL FROM supplier")
def sparql_union(spark, folder):
    r = sparql(spark, folder, "SELECT ?x ?low { { ?x d:c_nationkey ?n . VALUES ?n { <urn:d:nation:0> <urn:d:nation:1> <urn:d:nation:2> <urn:d:nation:3> <urn:d:nation:4> } BIND(true AS ?low) } UNION { ?x a d:Supplier } }")
    return texts(r.solutions, x="x", low="low:b")


@query("SELECT 'urn:d:nation:' || n_nationkey AS n FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 7000)")
def sparql_minus(spark, folder):
    return texts(sparql(spark, folder, "SELECT ?n { ?n a d:Nation MINUS { ?s d:s_nationkey ?n ; d:s_acctbal ?b FILTER(?b > 7000) } }").solutions, n="n")


@query("SELECT 'urn:d:nation:' || n_nationkey AS n FROM nation WHERE EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9900)")
def sparql_exists(spark, folder):
    return texts(sparql(spark, folder, "SELECT ?n { ?n a d:Nation FILTER EXISTS { ?c d:c_nationkey ?n ; d:c_acctbal ?b FILTER(?b > 9900) } }").solutions, n="n")


@query("""SELECT 'urn:d:part:' || p_partkey AS p, upper(p_name) AS u, length(p_name) AS len, CAST(p_size * 2 + 1 AS BIGINT) AS z FROM part
WHERE (contains(p_name, 'red') OR starts_with(p_name, 'small')) AND ends_with(p_name, 't') AND NOT p_size IN (1, 2, 3) AND regexp_matches(p_type, '^(?i)promo|^(?i)large')""")
def sparql_functions(spark, folder):
    r = sparql(spark, folder, """SELECT ?p (UCASE(?name) AS ?u) (STRLEN(?name) AS ?len) (?s * 2 + 1 AS ?z) { ?p d:p_name ?name ; d:p_size ?s ; d:p_type ?t
        FILTER((CONTAINS(?name, "red") || STRSTARTS(?name, "small")) && STRENDS(?name, "t") && !(?s IN (1, 2, 3)) && REGEX(?t, "^promo|^large", "i")) }""")
    return texts(r.solutions, p="p", u="u", len="len:i", z="z:i")


@query("SELECT 'urn:d:orders:' || o_orderkey AS o FROM orders WHERE o_orderdate >= TIMESTAMP '1998-06-01' AND o_orderdate < TIMESTAMP '1998-07-01'")
def sparql_dates(spark, folder):
    r = sparql(spark, folder, 'PREFIX xsd: <http://www.w3.org/2001/XMLSchema#> SELECT ?o { ?o d:o_orderdate ?t FILTER(?t >= "1998-06-01T00:00:00"^^xsd:dateTime && ?t < "1998-07-01T00:00:00"^^xsd:dateTime && DATATYPE(?t) = xsd:dateTime) }')
    return texts(r.solutions, o="o")


@query("SELECT DISTINCT 'urn:d:nation:' || c_nationkey AS n, c_mktsegment AS seg FROM customer")
def sparql_distinct(spark, folder):
    return texts(sparql(spark, folder, "SELECT DISTINCT ?n ?seg { ?c d:c_nationkey ?n ; d:c_mktsegment ?seg }").solutions, n="n", seg="seg")


@query("SELECT 'urn:d:orders:' || o_orderkey AS o, o_totalprice AS t FROM orders ORDER BY o_totalprice DESC, 1 LIMIT 10 OFFSET 5")
def sparql_order_limit(spark, folder):
    return texts(sparql(spark, folder, "SELECT ?o ?t { ?o d:o_totalprice ?t } ORDER BY DESC(?t) ?o LIMIT 10 OFFSET 5").solutions, o="o", t="t:n")


@query("SELECT EXISTS (SELECT 1 FROM customer WHERE c_acctbal > 9990) AS yes")
def sparql_ask(spark, folder):
    return spark.createDataFrame([(sparql(spark, folder, "ASK { ?c d:c_acctbal ?b FILTER(?b > 9990) }").answer,)], "yes boolean")


@query("SELECT DISTINCT 'urn:d:region:' || n_regionkey AS s, 'urn:d:hasSegment' AS p, c_mktsegment AS o FROM customer JOIN nation ON c_nationkey = n_nationkey")
def sparql_construct(spark, folder):
    r = sparql(spark, folder, "CONSTRUCT { ?r d:hasSegment ?seg } WHERE { ?c d:c_nationkey/d:n_regionkey ?r ; d:c_mktsegment ?seg }")
    return r.triples.select("s", "p", terms.plain(F.col("o")).alias("o"))


@query("""SELECT 'urn:d:nation:' || n_nationkey AS s, 'urn:d:n_name' AS p, n_name AS o FROM nation WHERE n_regionkey = 2 UNION ALL SELECT 'urn:d:nation:' || n_nationkey, 'urn:d:n_regionkey', 'urn:d:region:2' FROM nation WHERE n_regionkey = 2
UNION ALL SELECT 'urn:d:nation:' || n_nationkey, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'urn:d:Nation' FROM nation WHERE n_regionkey = 2""")
def sparql_describe(spark, folder):
    r = sparql(spark, folder, "DESCRIBE ?n WHERE { ?n d:n_regionkey <urn:d:region:2> }")
    return r.triples.select("s", "p", terms.plain(F.col("o")).alias("o"))


@query("""SELECT 'urn:d:nation:' || n.n_nationkey AS x FROM nation n WHERE n.n_regionkey = 3 UNION SELECT 'urn:d:region:3' UNION SELECT 'urn:d:nation:3'""")
def sparql_path_star(spark, folder):
    return texts(sparql(spark, folder, "SELECT DISTINCT ?x { <urn:d:nation:3> (d:n_regionkey|^d:n_regionkey)* ?x }").solutions, x="x")


@query("""SELECT 'urn:d:nation:' || n_nationkey AS s, 'urn:d:nation:' || n_nationkey AS o FROM nation UNION SELECT 'urn:d:nation:' || n_nationkey, 'urn:d:region:' || n_regionkey FROM nation""")
def sparql_path_optional(spark, folder):
    return texts(sparql(spark, folder, "SELECT ?s ?o { ?s a d:Nation . ?s d:n_regionkey? ?o }").solutions, s="s", o="o")


@query("SELECT n_name AS o FROM nation WHERE n_nationkey = 7")
def sparql_path_negated(spark, folder):
    return texts(sparql(spark, folder, "SELECT ?o { <urn:d:nation:7> !(a|d:n_regionkey) ?o }").solutions, o="o")


@query("SELECT 'urn:d:nation:' || c_nationkey AS n, max(b) AS best FROM (SELECT c_nationkey, max(c_acctbal) AS b FROM customer GROUP BY c_nationkey, c_mktsegment) GROUP BY 1")
def sparql_subquery(spark, folder):
    r = sparql(spark, folder, "SELECT ?n (MAX(?b) AS ?best) { { SELECT ?n ?seg (MAX(?x) AS ?b) { ?c d:c_nationkey ?n ; d:c_mktsegment ?seg ; d:c_acctbal ?x } GROUP BY ?n ?seg } } GROUP BY ?n")
    return texts(r.solutions, n="n", best="best:n")


@query("SELECT l_quantity AS q, count(*) AS n FROM lineitem WHERE l_partkey = 7 GROUP BY 1")
def sparql_star(spark, folder):
    r = sparql(spark, folder, "SELECT ?q (COUNT(*) AS ?n) { << ?l d:l_partkey <urn:d:part:7> >> d:quantity ?q } GROUP BY ?q", notes=True)
    return texts(r.solutions, q="q:n", n="n:i")


@query("""SELECT 'urn:d:supplier:' || s_suppkey AS s, count(DISTINCT l_partkey) AS parts, CAST(sum(p_size) AS BIGINT) AS total, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS brands, min(p_name) AS first
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def sparql_aggregates(spark, folder):
    r = sparql(spark, folder, """SELECT ?s (COUNT(DISTINCT ?p) AS ?parts) (SUM(?z) AS ?total) (GROUP_CONCAT(DISTINCT ?b; SEPARATOR=",") AS ?brands) (MIN(?name) AS ?first)
        { ?l d:l_suppkey ?s ; d:l_partkey ?p . ?p d:p_size ?z ; d:p_brand ?b ; d:p_name ?name } GROUP BY ?s""")
    return texts(r.solutions, s="s", parts="parts:i", total="total:i", brands="brands", first="first")


@query("SELECT 0 AS n")
def sparql_empty_aggregate(spark, folder):
    return texts(sparql(spark, folder, "SELECT (COUNT(*) AS ?n) { ?c d:c_acctbal 123456789 }").solutions, n="n:i").select(F.col("n").cast("int").alias("n"))


# --- vectors -----------------------------------------------------------------------------------------

EMB = "(SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"
COS = "list_dot_product(a.e, q.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(q.e, q.e)))"


def space(spark, folder) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.lit("emb").alias("space"), F.concat(F.lit("urn:d:vec:"), F.col("vec_id").cast("string")).alias("node"), F.col("embedding").alias("vec"), "label")


def first_vector(spark, folder) -> list[float]:
    return list(table(spark, folder, "embeddings").where("vec_id = 0").first()["embedding"])


@query(f"SELECT 'urn:d:vec:' || a.vec_id AS node, round({COS}, 6) AS score FROM {EMB} a, {EMB} q WHERE q.vec_id = 0 ORDER BY {COS} DESC, 1 LIMIT 20")
def vector_top_k(spark, folder):
    return vectors.top_k(space(spark, folder), first_vector(spark, folder), 20).withColumn("score", F.round("score", 6))


@query(f"SELECT 'urn:d:vec:' || a.vec_id AS node, round({COS}, 6) AS score FROM {EMB} a, {EMB} q WHERE q.vec_id = 0 AND a.label = 3 ORDER BY {COS} DESC, 1 LIMIT 10")
def vector_in_set(spark, folder):
    allowed = space(spark, folder).where("label = 3").select("node")
    return vectors.top_k(space(spark, folder), first_vector(spark, folder), 10, "emb", allowed).withColumn("score", F.round("score", 6))


@query(f"SELECT 'urn:d:vec:' || a.vec_id AS node, round({COS}, 6) AS score FROM {EMB} a, {EMB} q WHERE q.vec_id = 0 ORDER BY {COS} DESC, 1 LIMIT 5")
def vector_int8(spark, folder):
    return vectors.top_k_int8(space(spark, folder), first_vector(spark, folder), 5, width=100).withColumn("score", F.round("score", 6))


@query(f"""SELECT q.vec_id AS query, row_number() OVER (PARTITION BY q.vec_id ORDER BY {COS} DESC, 'urn:d:vec:' || a.vec_id)::INT AS rank, 'urn:d:vec:' || a.vec_id AS node, round({COS}, 6) AS score
FROM {EMB} a, {EMB} q WHERE q.vec_id % 50 = 0 QUALIFY rank <= 5""")
def vector_batch(spark, folder):
    queries = table(spark, folder, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vec"))
    return vectors.batch_top_k(space(spark, folder), queries, 5).withColumn("score", F.round("score", 6))


@query(f"""SELECT node, label, score FROM (SELECT a.vec_id, 'urn:d:vec:' || a.vec_id AS node, a.label, round({COS}, 6) AS score FROM {EMB} a, {EMB} q WHERE q.vec_id = 0 ORDER BY {COS} DESC, 2 LIMIT 8)""")
def vector_seed_join(spark, folder):
    """VECTOR_NEAR binds nodes, a pattern joins them, and the score stays beside."""
    rows = space(spark, folder)
    quads = rows.select(F.lit("").alias("g"), F.col("node").alias("s"), F.lit(D + "label").alias("p"), terms.integer(F.col("label").cast("bigint")).alias("o"), F.lit(None).cast("string").alias("edge_id"))
    q = first_vector(spark, folder)
    run = Cypher(Snapshot.of(quads), spark, Vocabulary(D), lambda name, k, allowed: vectors.top_k(rows, q, k, name, allowed))
    df = run.run("CALL VECTOR_NEAR(v, 'emb', 8) YIELD v, score MATCH (v) RETURN v AS node, v.label AS label, score")
    return df.select("node", F.col("label").cast("int").alias("label"), F.round(F.col("score").cast("double"), 6).alias("score"))


# --- graphs, access, ontology, inference, shapes ---------------------------------------------------------


@query(f"SELECT g, count(*) AS n FROM {GRAPHS} WHERE g IN ('', 'urn:g:BUILDING', 'urn:g:MACHINERY') GROUP BY g")
def access_readable(spark, folder):
    grants = spark.createDataFrame([("ann", "urn:g:BUILDING", "read"), ("team", "urn:g:MACHINERY", "write"), ("bob", "urn:g:AUTOMOBILE", "admin")], access.GRANTS)
    members = spark.createDataFrame([("ann", "team")], "user string, grp string")
    return access.visible_quads(segment_graphs(spark, folder), grants, members, "ann").groupBy("g").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'urn:d:orders:' || o_orderkey AS o, 'urn:d:customer:' || o_custkey AS c FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def access_nodes(spark, folder):
    rows = conjunction(spark, folder, Pattern(V("o"), P("o_custkey"), V("c"))).df
    orders = table(spark, folder, "orders").select(iri("orders", F.col("o_orderkey")).alias("n"))
    allowed = orders.unionByName(table(spark, folder, "customer").where("c_mktsegment = 'BUILDING'").select(iri("customer", F.col("c_custkey")).alias("n")))
    return texts(access.visible_rows(rows, ["o", "c"], allowed), o="o", c="c")


@query("SELECT 'views' AS namespace, 'urn:d:user:' || user_id AS node, CAST(sum(event_id) AS BIGINT) AS value FROM events GROUP BY user_id")
def counters(spark, folder):
    ev = table(spark, folder, "events")
    return access.counters(ev.select(F.lit("views").alias("namespace"), iri("user", F.col("user_id")).alias("node"), F.col("event_id").alias("delta")))


@query("""SELECT 'urn:d:nation:' || c_nationkey AS subject, 'one-subject' AS rule, count(*) AS n FROM (SELECT c_nationkey, count(*) FROM customer GROUP BY 1 HAVING count(*) > 1) GROUP BY 1
UNION ALL SELECT 'urn:d:customer:' || c_custkey, 'required', 1 FROM customer UNION ALL SELECT 'urn:d:customer:' || c_custkey, 'range', 1 FROM customer WHERE c_nationkey >= 20""")
def ontology_validate(spark, folder):
    tables = table(spark, folder, "nation").where("n_nationkey < 20").select(iri("nation", F.col("n_nationkey")).alias("s"), F.lit("urn:d:Nation").alias("t"))
    quads = store(spark, folder).scan(p=P("c_nationkey")).unionByName(store(spark, folder).scan(p=U(RDF_TYPE), o=U("urn:d:Customer")))
    typed = tables.select(F.lit("").alias("g"), "s", F.lit(RDF_TYPE).alias("p"), terms.node(F.col("t")).alias("o"), F.lit(None).cast("string").alias("edge_id"))
    r = ontology.Registry()
    r.register_node(ontology.NodeType("urn:d:Customer", {D + "nick": ontology.Field("text", True)}))
    r.register_edge(ontology.EdgeType(D + "c_nationkey", "urn:d:Customer", "urn:d:Nation", "many_to_one"))
    return r.validate(quads.unionByName(typed)).groupBy("subject", "rule").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT s AS subject, o AS detail FROM {EDGES} e WHERE NOT EXISTS (SELECT 1 FROM {EDGES} f WHERE f.s = e.o AND f.o = e.s)")
def ontology_inverse(spark, folder):
    """A relation declared its own inverse, where the way back is missing."""
    r = ontology.Registry()
    r.register_edge(ontology.EdgeType(D + "refers", inverse=D + "refers"))
    return r.validate_inverses(referral_quads(spark, folder)).select("subject", "detail")


def company(spark, folder) -> DataFrame:
    """Customers in nations in regions under one transitive part-of, with classes above each other."""
    u = lambda df, s, p, o: df.select(F.lit("").alias("g"), s.alias("s"), F.lit(p).alias("p"), terms.node(o).alias("o"))
    c, n = table(spark, folder, "customer"), table(spark, folder, "nation")
    one = spark.range(1)
    schema = [("c_in", RDFS + "subPropertyOf", D + "partOf"), ("n_in", RDFS + "subPropertyOf", D + "partOf"), ("partOf", RDF_TYPE, OWL + "TransitiveProperty"), ("partOf", OWL + "inverseOf", D + "hasPart"), ("c_in", RDFS + "domain", D + "Customer"), ("n_in", RDFS + "range", D + "Region"), ("Customer", RDFS + "subClassOf", D + "Agent"), ("Agent", RDFS + "subClassOf", D + "Thing")]
    parts = [u(c, iri("customer", F.col("c_custkey")), D + "c_in", iri("nation", F.col("c_nationkey"))), u(n, iri("nation", F.col("n_nationkey")), D + "n_in", iri("region", F.col("n_regionkey")))]
    out = parts[0].unionByName(parts[1])
    for s, p, o in schema:
        out = out.unionByName(u(one, F.lit(D + s), p, F.lit(o)))
    return out


OWL_COUNTS = """SELECT 'urn:d:partOf' AS p, 2 * (SELECT count(*) FROM customer) + (SELECT count(*) FROM nation) AS n
UNION ALL SELECT 'urn:d:hasPart', 2 * (SELECT count(*) FROM customer) + (SELECT count(*) FROM nation)
UNION ALL SELECT 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 3 * (SELECT count(*) FROM customer) + (SELECT count(DISTINCT n_regionkey) FROM nation)
UNION ALL SELECT 'http://www.w3.org/2000/01/rdf-schema#subClassOf', 1"""


@query(OWL_COUNTS)
def owl_materialize(spark, folder):
    return owl.materialize(company(spark, folder)).groupBy("p").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 'urn:d:partOf' AS p, 2 * (SELECT count(*) FROM customer WHERE c_custkey % 10 <> 0) + (SELECT count(*) FROM nation) AS n
UNION ALL SELECT 'urn:d:hasPart', 2 * (SELECT count(*) FROM customer WHERE c_custkey % 10 <> 0) + (SELECT count(*) FROM nation)
UNION ALL SELECT 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 3 * (SELECT count(*) FROM customer WHERE c_custkey % 10 <> 0) + (SELECT count(DISTINCT n_regionkey) FROM nation)
UNION ALL SELECT 'http://www.w3.org/2000/01/rdf-schema#subClassOf', 1""")
def owl_incremental(spark, folder):
    """Every tenth customer leaves: what followed from that goes, the rest stays."""
    quads = Scratch(spark, "owl-query").save(company(spark, folder), "quads")
    gone = quads.where((F.col("p") == D + "c_in") & (F.regexp_extract("s", r"(\d+)$", 1).cast("bigint") % 10 == 0))
    inferred = owl.materialize(quads)
    return owl.incremental(quads, inferred, quads.where(F.lit(False)), gone).groupBy("p").agg(F.count(F.lit(1)).alias("n"))


SHAPES = """@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix d: <urn:d:> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
d:CustomerShape a sh:NodeShape ; sh:targetClass d:Customer ;
  sh:property [ sh:path d:c_acctbal ; sh:minInclusive 0.0 ; sh:datatype xsd:double ] ;
  sh:property [ sh:path d:c_mktsegment ; sh:in ( "BUILDING" "MACHINERY" "HOUSEHOLD" ) ; sh:maxCount 1 ] ;
  sh:property [ sh:path d:c_name ; sh:pattern "[02468]$" ; sh:minLength 5 ; sh:maxLength 18 ] ;
  sh:property [ sh:path ( d:c_nationkey d:n_regionkey ) ; sh:minCount 1 ; sh:class d:Region ; sh:nodeKind sh:IRI ] ;
  sh:property [ sh:path [ sh:inversePath d:o_custkey ] ; sh:minCount 1 ; sh:maxCount 20 ] .
"""


@query("""WITH o AS (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)
SELECT component, n FROM (SELECT 'MinInclusive' AS component, count(*) AS n FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'In', count(*) FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD')
UNION ALL SELECT 'Pattern', count(*) FROM customer WHERE NOT regexp_matches(c_name, '[02468]$') UNION ALL SELECT 'MinCount', count(*) FROM o WHERE n < 1 UNION ALL SELECT 'MaxCount', count(*) FROM o WHERE n > 20) WHERE n > 0""")
def shacl_report(spark, folder):
    snap = store(spark, folder)
    wanted = [RDF_TYPE, *[D + p for p in ("c_acctbal", "c_mktsegment", "c_name", "c_nationkey", "n_regionkey", "o_custkey")]]
    quads = snap.source(wanted[0])
    for p in wanted[1:]:
        quads = quads.unionByName(snap.source(p))
    found = shacl.validate(rdf.parse_turtle(SHAPES), quads.select("g", "s", "p", "o"))
    return found.groupBy(F.regexp_extract("component", r"#(\w+)ConstraintComponent$", 1).alias("component")).agg(F.count(F.lit(1)).alias("n"))


# --- sources, writes, feed -----------------------------------------------------------------------------


@query("SELECT 'urn:d:customer:' || c_custkey AS s, c_name AS name, c_acctbal AS bal FROM customer")
def rdf_round_trip(spark, folder):
    """Customers written as N-Quads and read back."""
    snap, scratch = store(spark, folder), Scratch(spark, "rdf-query")
    quads = snap.source(D + "c_name").unionByName(snap.source(D + "c_acctbal"))
    rdf.write(quads, f"{scratch.root}/nq", "nq")
    back = rdf.read(spark, f"{scratch.root}/nq", "nq")
    name = back.where(F.col("p") == D + "c_name").select("s", F.col("o.str").alias("name"))
    return name.join(back.where(F.col("p") == D + "c_acctbal").select("s", F.col("o.dbl").alias("bal")), "s")


@query("SELECT 'urn:d:nation:' || n_nationkey AS s, n_name AS name, 'urn:d:region:' || n_regionkey AS r FROM nation")
def turtle_round_trip(spark, folder):
    snap, scratch = store(spark, folder), Scratch(spark, "ttl-query")
    rdf.write(snap.source(D + "n_name").unionByName(snap.source(D + "n_regionkey")), f"{scratch.root}/ttl", "ttl")
    back = rdf.read(spark, f"{scratch.root}/ttl", "ttl")
    return texts(Builder(Snapshot.of(back), spark).conjunction([Pattern(V("s"), P("n_name"), V("name")), Pattern(V("s"), P("n_regionkey"), V("r"))]), s="s", name="name", r="r")


def ticking(start: int = 1_000_000):
    times = iter(range(start, 1 << 62, 1000))
    return lambda: next(times)


def filled(spark, folder) -> Store:
    """A store of customers' segments and balances; then every fifth balance is replaced by 0 and every seventh segment closed."""
    st = Store(spark, Scratch(spark, "store-query").root, ticking())
    snap = store(spark, folder)
    cols = ["g", "s", "p", "o"]
    st.commit(snap.source(D + "c_mktsegment").unionByName(snap.source(D + "c_acctbal")).select(*cols))
    number = F.regexp_extract("s", r"(\d+)$", 1).cast("bigint")
    st.commit(snap.source(D + "c_acctbal").where(number % 5 == 0).withColumn("o", terms.double(F.lit(0.0))).select(*cols), mode="auto", author="audit")
    st.commit(retracts=snap.source(D + "c_mktsegment").where(number % 7 == 0).select(*cols), author="audit")
    return st


@query("""SELECT 'urn:d:customer:' || c_custkey AS s, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE c_acctbal END AS bal, CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS seg FROM customer""")
def write_modes(spark, folder):
    live = filled(spark, folder).live()
    bal = live.where(F.col("p") == D + "c_acctbal").select("s", F.col("o.dbl").alias("bal"))
    return bal.join(live.where(F.col("p") == D + "c_mktsegment").select("s", F.col("o.str").alias("seg")), "s", "left")


@query("SELECT 'urn:d:customer:' || c_custkey AS s, c_acctbal AS bal FROM customer")
def time_travel(spark, folder):
    """Balances as known after the first commit, before the others."""
    st = filled(spark, folder)
    first = min(e["ts"] for e in st.log())
    return st.live(tt=first).where(F.col("p") == D + "c_acctbal").select("s", F.col("o.dbl").alias("bal"))


@query("""SELECT 'audit' AS author, 'close' AS kind, (SELECT count(*) FROM customer WHERE c_custkey % 5 = 0 AND c_acctbal <> 0) + (SELECT count(*) FROM customer WHERE c_custkey % 7 = 0) AS n
UNION ALL SELECT 'audit', 'assert', count(*) FROM customer WHERE c_custkey % 5 = 0""")
def change_feed(spark, folder):
    st = filled(spark, folder)
    out = f"{st.path}/seen"
    rows = lambda df, i: df.select("author", "kind").write.mode("append").parquet(out)
    first = min(e["ts"] for e in st.log())
    changes.subscribe(spark, st, rows, f"{st.path}/checkpoint", after=first).awaitTermination()
    return spark.read.parquet(out).groupBy("author", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT g, n FROM (SELECT g, count(*) AS n FROM {GRAPHS} WHERE g NOT IN ('urn:g:BUILDING', 'urn:g:MACHINERY') GROUP BY g UNION ALL SELECT 'urn:g:MACHINERY', count(*) FROM {GRAPHS} WHERE g = 'urn:g:BUILDING')")
def graph_move(spark, folder):
    """One graph moved onto another: the target holds what the source held, the source is gone."""
    st = Store(spark, Scratch(spark, "graph-query").root, ticking())
    st.commit(segment_graphs(spark, folder).select("g", "s", "p", "o"))
    st.copy_graph("urn:g:BUILDING", "urn:g:MACHINERY", "move")
    return access.stats(st.live()).select("g", F.col("quads").alias("n"))


# --- an e-commerce suite -----------------------------------------------------------------------------------


@query("SELECT 'urn:d:part:' || p_partkey AS p FROM part WHERE p_type = 'PROMO' AND p_brand = 'Brand#4' AND p_size > 10")
def shop_q1_search(spark, folder):
    return texts(sparql(spark, folder, 'SELECT ?p { ?p d:p_type "PROMO" ; d:p_brand "Brand#4" ; d:p_size ?z FILTER(?z > 10) }').solutions, p="p")


@query("""SELECT 'urn:d:p_name' AS p, p_name AS o FROM part WHERE p_partkey = 11 UNION ALL SELECT 'urn:d:p_brand', p_brand FROM part WHERE p_partkey = 11
UNION ALL SELECT 'urn:d:p_type', p_type FROM part WHERE p_partkey = 11 UNION ALL SELECT 'urn:d:p_size', CAST(p_size AS VARCHAR) FROM part WHERE p_partkey = 11""")
def shop_q2_details(spark, folder):
    rows = texts(sparql(spark, folder, "SELECT ?p ?o { <urn:d:part:11> ?p ?o }").solutions, p="p", o="o")
    return rows.where(~F.col("p").isin(RDF_TYPE, D + "p_retailprice"))


@query("SELECT DISTINCT 'urn:d:part:' || a.l_partkey AS p FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey JOIN part ON a.l_partkey = p_partkey WHERE a.l_suppkey = 3 AND b.l_suppkey = 4 AND p_size BETWEEN 5 AND 40")
def shop_q3_two_features(spark, folder):
    return texts(sparql(spark, folder, "SELECT DISTINCT ?p { ?a d:l_partkey ?p ; d:l_suppkey <urn:d:supplier:3> . ?b d:l_partkey ?p ; d:l_suppkey <urn:d:supplier:4> . ?p d:p_size ?z FILTER(?z >= 5 && ?z <= 40) }").solutions, p="p")


@query("SELECT DISTINCT 'urn:d:part:' || l_partkey AS p FROM lineitem WHERE l_suppkey IN (3, 4)")
def shop_q4_union(spark, folder):
    return texts(sparql(spark, folder, "SELECT DISTINCT ?p { { ?a d:l_suppkey <urn:d:supplier:3> ; d:l_partkey ?p } UNION { ?b d:l_suppkey <urn:d:supplier:4> ; d:l_partkey ?p } }").solutions, p="p")


@query("SELECT DISTINCT 'urn:d:part:' || b.l_partkey AS p FROM lineitem a JOIN lineitem b ON a.l_suppkey = b.l_suppkey WHERE a.l_partkey = 7 AND b.l_partkey <> 7")
def shop_q5_similar(spark, folder):
    return texts(sparql(spark, folder, "SELECT DISTINCT ?p { ?a d:l_partkey <urn:d:part:7> ; d:l_suppkey ?s . ?b d:l_suppkey ?s ; d:l_partkey ?p FILTER(?p != <urn:d:part:7>) }").solutions, p="p")


@query("SELECT 'urn:d:part:' || p_partkey AS s FROM part WHERE contains(lower(p_name), 'ring')")
def shop_q6_full_text(spark, folder):
    return snapshot.text_search(store(spark, folder).source(D + "p_name"), "ring").select("s")


@query("""SELECT 'urn:d:supplier:' || s_suppkey AS s, n_name AS nation, l_extendedprice AS price FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE l_partkey = 7 ORDER BY price, 1 LIMIT 1""")
def shop_q7_cheapest(spark, folder):
    r = sparql(spark, folder, "SELECT ?s ?n ?price { ?l d:l_partkey <urn:d:part:7> ; d:l_suppkey ?s ; d:l_extendedprice ?price . ?s d:s_nationkey/d:n_name ?n } ORDER BY ?price ?s LIMIT 1")
    return texts(r.solutions, s="s", nation="n", price="price:n")


@query("SELECT 'urn:d:orders:' || o_orderkey AS o, c_name AS c FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_partkey = 7")
def shop_q8_reviews(spark, folder):
    return texts(sparql(spark, folder, "SELECT ?o ?c { ?l d:l_partkey <urn:d:part:7> ; d:l_orderkey ?o . ?o d:o_custkey/d:c_name ?c }").solutions, o="o", c="c")


@query("SELECT 'urn:d:o_orderstatus' AS p, o_orderstatus AS o FROM orders WHERE o_orderkey = 9 UNION ALL SELECT 'urn:d:o_custkey', 'urn:d:customer:' || o_custkey FROM orders WHERE o_orderkey = 9 UNION ALL SELECT 'urn:d:o_orderpriority', o_orderpriority FROM orders WHERE o_orderkey = 9")
def shop_q9_review_detail(spark, folder):
    rows = texts(sparql(spark, folder, "SELECT ?p ?o { <urn:d:orders:9> ?p ?o FILTER(?p IN (d:o_orderstatus, d:o_custkey, d:o_orderpriority)) }").solutions, p="p", o="o")
    return rows


@query("SELECT DISTINCT 'urn:d:part:' || l_partkey AS p FROM lineitem WHERE l_suppkey = 5")
def shop_q10_offers(spark, folder):
    return texts(sparql(spark, folder, "SELECT DISTINCT ?p { ?l d:l_suppkey <urn:d:supplier:5> ; d:l_partkey ?p }").solutions, p="p")


@query("SELECT count(*) AS n FROM lineitem WHERE l_partkey = 7")
def shop_q11_count(spark, folder):
    return texts(sparql(spark, folder, "SELECT (COUNT(?l) AS ?n) { ?l d:l_partkey <urn:d:part:7> }").solutions, n="n:i")


@query("SELECT DISTINCT 'urn:d:part:' || l_partkey AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey = 12")
def shop_q12_reviewed(spark, folder):
    return texts(sparql(spark, folder, "SELECT DISTINCT ?p { ?o d:o_custkey <urn:d:customer:12> . ?l d:l_orderkey ?o ; d:l_partkey ?p }").solutions, p="p")
