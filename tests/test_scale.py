"""What grows with tables: how many joins and rows a plan takes, beside the results."""

from pyspark.sql import functions as F

from quadspark import catalog
from quadspark.functions import terms
from quadspark.functions.terms import Value
from quadspark.operators.snapshot import Snapshot
from quadspark.plans import build
from quadspark.plans.build import Builder, Solutions
from quadspark.plans.cypher import Cypher, parse
from quadspark.plans.patterns import Pattern, Var, Vocabulary

P = lambda name: Value("U", "urn:d:" + name)


def joins(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join ")


def bound(spark, **columns):
    """Solutions whose variables are nodes of the given names, None for unbound."""
    names = tuple(columns)
    rows = list(zip(*columns.values(), strict=True))
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names)).select(*[terms.node(F.col(n)).alias(n) for n in names])
    return Solutions(df, names, frozenset(n for n in names if None not in columns[n]))


def listed(rows):
    names = sorted(v for v in rows.vars if not v.startswith("__"))
    return sorted(map(str, rows.df.select(*[F.col(n)["str"].alias(n) for n in names]).collect()))


def test_a_star_over_rows_of_a_table_takes_no_join(spark, small):
    own = [Pattern(Var("a"), P(q), Var(v)) for q, v in (("p_retailprice", "r"), ("p_size", "z"), ("p_brand", "b"))]
    rows = Builder(catalog.store(spark, small), spark).conjunction(own)
    assert joins(rows.df) == 0 and rows.df.count() == spark.read.parquet(f"{small}/part.parquet").count()


def test_a_star_linked_by_several_variables_is_joined_on_all_of_them(spark, monkeypatch):
    """All nodes share one price and none a size: a join on prices alone has 60 times 60 rows."""
    quads = spark.range(60).select(F.lit("").alias("g"), F.concat(F.lit("urn:n:"), "id").alias("s"), F.explode(F.array(F.struct(F.lit("urn:d:price").alias("p"), F.lit(1).cast("long").alias("v")), F.struct(F.lit("urn:d:size").alias("p"), F.col("id").alias("v")))).alias("x"))
    quads = quads.select("g", "s", "x.p", terms.integer(F.col("x.v")).alias("o"), F.lit(None).cast("string").alias("edge_id")).cache()
    sizes, plain = [], build.join
    monkeypatch.setattr(build, "join", lambda *a, **b: (out := plain(*a, **b), sizes.append(out.df.count()))[0])
    rows = Builder(Snapshot.of(quads), spark).conjunction([Pattern(Var(x), P(q), Var(v)) for x in ("a", "b") for q, v in (("price", "r"), ("size", "z"))])
    assert rows.df.count() == 60 and max(sizes) == 60


def test_many_rows_of_a_key_on_both_sides_are_dealt_into_cells(spark, monkeypatch):
    monkeypatch.setattr(build, "CELL", 4)
    a = bound(spark, x=[f"x{k}" for k in range(30)], n=["hot"] * 25 + ["cold"] * 2 + ["none"] * 3)
    b = bound(spark, y=[f"y{k}" for k in range(20)], n=["hot"] * 18 + ["cold", "other"])
    assert listed(build.spread_join(a, b)) == listed(build.join(a, b))


def test_rows_that_bind_nothing_shared_are_not_compared_with_all(spark):
    a = bound(spark, x=["1", "2", "3", "4"], n=["p", "q", None, "r"])
    b = bound(spark, y=["1", "2", "3"], n=["p", "p", None])
    gone = build.join(a, b, "left_anti", overlap=True)
    assert listed(gone) == listed(bound(spark, x=["2", "3", "4"], n=["q", None, "r"]))
    assert "NestedLoop" not in gone.df._jdf.queryExecution().executedPlan().toString()
    assert listed(build.join(a, b, "left_semi")) == listed(a) and not listed(build.join(a, b, "left_anti"))


def test_many_pairs_that_are_only_counted_are_not_made(spark):
    quads = spark.range(200).select(F.lit("").alias("g"), F.concat(F.lit("urn:n:"), "id").alias("s"), F.when(F.col("id") % 2 == 0, "urn:d:a").otherwise("urn:d:b").alias("p"), terms.node(F.lit("urn:n:one")).alias("o"), F.lit(None).cast("string").alias("edge_id"))
    run = Cypher(Snapshot.of(quads), spark, Vocabulary("urn:d:"))
    text = "MATCH (x)-[:a]->(n), (y)-[:b]->(n) RETURN n, count(*) AS pairs, count(n) AS c"
    assert run.bindings(parse(text), {}).df.count() == 1
    assert [tuple(r) for r in run.run(text).collect()] == [("urn:n:one", 10_000, 10_000)]


def test_an_optional_step_from_bound_nodes_reads_no_other_table(spark, small):
    rows = catalog.QUERIES["sparql_path_optional"](spark, small)
    assert "part.parquet" not in str(rows.inputFiles())


def test_a_batch_search_holds_few_scores_at_once(spark, monkeypatch):
    import numpy as np

    from quadspark.operators import vectors

    rng = np.random.default_rng(1)
    data = [(f"n{k:03}", [float(x) for x in rng.integers(-2, 3, 4)]) for k in range(300)]
    rows = spark.createDataFrame([(f"n{k}", v) for k, v in data], "node string, vec array<double>").where("aggregate(vec, 0D, (a, x) -> a + x * x) > 0").coalesce(1)
    queries = rows.select(F.col("node").alias("query"), "vec").limit(60)
    found = lambda: sorted((r.query, r["rank"], round(r.score, 9)) for r in vectors.batch_top_k(rows, queries, 3).collect())
    wanted = found()
    monkeypatch.setattr(vectors, "SCORES", 64)
    assert found() == wanted


def test_a_trimmed_search_keeps_no_more_ties_than_it_needs():
    import numpy as np
    import pyarrow as pa

    from quadspark.operators import vectors

    q, node, score = vectors._trimmed((np.zeros(500, int), pa.array([f"n{k:03}" for k in range(499, -1, -1)]), np.ones(500)), 3)
    assert sorted(node.to_pylist()) == ["n000", "n001", "n002"]


def test_a_compaction_keeps_the_state_apart_from_older_versions(spark):
    from quadspark.operators.store import Store
    from quadspark.scratch import Scratch
    from quadspark.sources import rdf

    st = Store(spark, Scratch(spark, "folded").root)
    quad = lambda v: rdf.quads_of(spark, [("", "urn:s", "urn:p", Value("I", v))]).select("g", "s", "p", "o")
    st.commit(quad(1))
    st.commit(quad(1))
    st.commit(quad(2))
    st.compact()
    ident = next(e["id"] for e in st.log() if "state" in e)
    assert st._folded(st._compaction()).count() == 2 and st.versions().count() == 3
    assert st.log()[-1]["state"] == {"one_graph": True, "many": ["urn:p"], "folded": True}
    fs, p = st._fs(f"{st.path}/state/{ident}")
    assert not fs.exists(p)


def test_heads_that_no_rule_uses_stay_out_of_the_rounds(spark, small, monkeypatch):
    from quadspark.operators import recursion

    seen, plain = [], recursion.fixpoint
    monkeypatch.setattr(recursion, "fixpoint", lambda scratch, heads, *rest: (seen.append(heads), plain(scratch, heads, *rest))[1])
    assert catalog.QUERIES["rules_recursive"](spark, small).count() and seen == [{"anc"}]


def test_tasks_of_many_pairs_grow_with_the_pairs(spark, monkeypatch):
    monkeypatch.setattr(build, "TASK_PAIRS", 4, raising=False)
    a = bound(spark, x=[f"x{k}" for k in range(60)], n=["hot"] * 60)
    b = bound(spark, y=[f"y{k}" for k in range(40)], n=["hot"] * 40)
    rows = build.spread_join(a, b).df
    assert rows.count() == 2400 and "RepartitionByExpression" in (plan := rows._jdf.queryExecution().optimizedPlan().toString()) and ", 600" in plan
