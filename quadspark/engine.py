"""The facade: one store, three query languages, and what belongs to them."""

from __future__ import annotations

import contextlib
import threading
import uuid
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadspark.functions import terms
from quadspark.functions.terms import RDF_TYPE, Value
from quadspark.operators import owl, shacl
from quadspark.operators.ontology import Registry
from quadspark.operators.snapshot import INFERRED, Snapshot, history, latest_annotations
from quadspark.operators.store import Store
from quadspark.plans import cypher, sparql_parser
from quadspark.plans.build import Builder, Solutions, explain
from quadspark.plans.cypher import Cypher
from quadspark.plans.patterns import Graph, Pattern, Query, Var, Vocabulary, parse_pattern
from quadspark.plans.sparql import Result, Sparql
from quadspark.scratch import Scratch
from quadspark.sources import rdf
from quadspark.streaming import changes


#: The graph of registered types.
TYPES = "urn:q:types"


class DeadlineExceeded(Exception):
    """What ran under a deadline was cancelled."""


class Malformed(ValueError):
    """An import met lines that it cannot read."""


class Engine:
    """Queries and writes on a :class:`Store`."""

    def __init__(self, spark: SparkSession, store: Store, vocabulary: Vocabulary | None = None, registry: Registry | None = None):
        """With a ``registry`` patterns are pruned by the declared types of their predicates' ends."""
        self.spark, self.store, self.vocabulary, self.registry = spark, store, vocabulary or Vocabulary(), registry

    def snapshot(self, vt: int | None = None, tt: int | None = None, readable: list[str] | None = None, inferred: bool = True) -> Snapshot:
        return self.store.snapshot(vt, tt).restricted(readable, inferred)

    # --- queries -------------------------------------------------------------------------------

    def datalog(self, patterns: list[str | Pattern], rules=(), seed: DataFrame | None = None, graph: Graph | None = None, **at) -> Solutions:
        parsed = [parse_pattern(p, self.vocabulary) if isinstance(p, str) else p for p in patterns]
        query = Query(parsed, list(rules))
        query = query.scoped(graph) if graph else query
        start = Solutions(seed, tuple(seed.columns), frozenset(seed.columns)) if seed is not None else None
        return Builder(self.snapshot(**at), self.spark, self.registry).query(query, start)

    def explain(self, patterns: list[str | Pattern], rules=()) -> list[dict]:
        return explain([parse_pattern(p, self.vocabulary) if isinstance(p, str) else p for p in patterns], rules)

    def sparql(self, text: str, default_graphs=(), named_graphs=(), **at) -> Result:
        return Sparql(self.snapshot(**at), self.spark, self.vocabulary.prefixes).run(text, default_graphs, named_graphs)

    def cypher(self, text: str, params: dict | None = None, graphs: list[str] | None = None, near: dict[str, list[float]] | None = None, **at) -> DataFrame:
        """``near`` has the query vector of each space that VECTOR_NEAR names."""
        tree = cypher.parse(text)
        if tree.writes:
            return self._cypher_write(tree, params or {})
        snapshot = self.snapshot(**at)
        return Cypher(snapshot, self.spark, self.vocabulary, self._search(near or {}, snapshot), graphs).run(text, params)

    @contextlib.contextmanager
    def deadline(self, seconds: float):
        """Everything that runs inside is cancelled after this time and ends in :class:`DeadlineExceeded`;
        that goes for the rounds of closures and rules too."""
        group, context = f"deadline-{uuid.uuid4().hex}", self.spark.sparkContext
        passed = threading.Event()

        def cancel() -> None:
            passed.set()
            context._jsc.sc().cancelJobGroupAndFutureJobs(group)

        context.setJobGroup(group, "under a deadline", True)
        timer = threading.Timer(seconds, cancel)
        timer.daemon = True
        timer.start()
        try:
            yield
        except Exception as e:
            if passed.is_set():
                raise DeadlineExceeded(f"not done within {seconds} seconds") from e
            raise
        finally:
            timer.cancel()
            for name in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
                context.setLocalProperty(name, None)

    def stream_rows(self, df: DataFrame, size: int = 500) -> Iterator[list]:
        """Rows of a whole plan in chunks, a partition at a time."""
        chunk = []
        for row in df.toLocalIterator(prefetchPartitions=True):
            chunk.append(row)
            if len(chunk) == size:
                yield chunk
                chunk = []
        if chunk:
            yield chunk

    def _search(self, near: dict[str, list[float]], snapshot: Snapshot):
        """The search of VECTOR_NEAR: visible nodes only, by the index of the space if there is one."""
        def search(space: str, k: int, allowed: DataFrame | None, ef: int | None = None) -> DataFrame:
            return self.store.nearest(space, near[space], k, ef, self._visible(snapshot, allowed))

        return search

    def _visible(self, snapshot: Snapshot, allowed: DataFrame | None = None) -> DataFrame:
        """``(node)``: subjects of live quads of the snapshot, among ``allowed``."""
        seen = snapshot.scan(graph=Graph("all")).select(F.col("s").alias("node")).distinct()
        return seen if allowed is None else seen.join(allowed.select("node").distinct(), "node", "left_semi")

    def vector_search(
        self, space: str, query: list[float], k: int, allowed: DataFrame | None = None, node_type: str | None = None, reachable: tuple[str, str] | None = None, ef: int | None = None, exact: bool = False, candidates: tuple[list[str | Pattern], str] | None = None, **at
    ) -> DataFrame:
        """``(node, score)``: top k among visible nodes; every filter comes before the ranking.

        ``node_type`` is a type, ``reachable`` a start and a predicate to follow from it, ``candidates``
        patterns and the variable whose nodes count. By the index of the space unless ``exact``; ``ef`` is
        the breadth of the search in it.
        """
        snap = self.snapshot(**at)
        rows = self._visible(snap, allowed)
        if node_type:
            typed = snap.scan(p=Value("U", RDF_TYPE), o=Value("U", node_type)).select(F.col("s").alias("node"))
            rows = rows.join(typed.distinct(), "node", "left_semi")
        if reachable:
            start, predicate = reachable
            found = Builder(snap, self.spark).scan(Pattern(Value("U", start), Value("U", predicate), Var("x"), hops=(1, None)))
            rows = rows.join(found.df.select(F.col("x")["str"].alias("node")), "node", "left_semi")
        if candidates:
            patterns, var = candidates
            found = self.datalog(patterns, **at).df.select(F.col(f"`{var}`")["str"].alias("node"))
            rows = rows.join(found, "node", "left_semi")
        return self.store.nearest(space, query, k, ef, rows, exact)

    def vector_query(self, space: str, query: list[float], k: int, var: str, patterns: list[str | Pattern]) -> Solutions:
        """The k nearest nodes bind ``var``; patterns join them, and ``score`` stays beside."""
        hits = self.vector_search(space, query, k).select(terms.node(F.col("node")).alias(var), terms.double(F.col("score")).alias("score"))
        return self.datalog(patterns, seed=hits)

    def text_search(self, text: str, predicate: str | None = None) -> DataFrame:
        """Live literals that contain the text, in whatever case, by the text index where it is up to date."""
        return self.store.search_text(text, predicate)

    def history(self, subject: str, predicate: str, limit: int | None = 50) -> DataFrame:
        return history(self.store.versions(), subject, predicate, limit)

    # --- writes --------------------------------------------------------------------------------

    def insert(self, rows: list[tuple[str, str, str, Value]], mode: str = "add", author: str = "", annotations: list[tuple[int, str, Value]] = ()) -> int:
        """``annotations (n, predicate, value)`` are on the edge of the n-th row."""
        quads = rdf.quads_of(self.spark, rows)
        notes = None
        if annotations:
            edges = [rdf.quads_of(self.spark, [rows[n]]).select("edge_id", "g", F.lit(p).alias("p"), v.column().alias("o")) for n, p, v in annotations]
            parts = [e.where(F.col("edge_id").isNotNull()) for e in edges]
            notes = reduce(DataFrame.unionByName, parts)
        return self.store.commit(quads.select("g", "s", "p", "o"), annotations=notes, mode=mode, author=author)

    def read_rdf(self, path: str, fmt: str, graph: str = "", import_id: str = "0", skip_malformed: bool = False) -> int:
        """Loads a file or folder. Lines that cannot be read raise :class:`Malformed` before anything is
        written, unless they are to be skipped; :meth:`malformed` lists them."""
        if not skip_malformed and rdf.FORMATS[fmt] == "lines":
            bad = self.malformed(path)
            shown = [r[0] for r in bad.limit(3).collect()]
            if shown:
                raise Malformed(f"{bad.count()} lines cannot be read, such as {shown}")
        return self.store.bulk_load(rdf.read(self.spark, path, fmt, graph=graph, import_id=import_id))

    def malformed(self, path: str) -> DataFrame:
        """``(value)``: lines of an N-Triples or N-Quads file that cannot be read."""
        return rdf.read_lines(self.spark, path)[1]

    def export(self, path: str, fmt: str, graph: str | None = None, subjects: list[str] | None = None, predicates: list[str] | None = None, node_type: str | None = None) -> None:
        """Live quads as files; ``node_type`` limits subjects to those of a type. In the formats nts and
        ttls statements about edges are added as quoted triples."""
        rows = self.store.live()
        rows = rows if graph is None else rows.where(F.col("g") == graph)
        rows = rows if subjects is None else rows.where(F.col("s").isin(*subjects))
        rows = rows if predicates is None else rows.where(F.col("p").isin(*predicates))
        if node_type is not None:
            typed = self.store.live().where((F.col("p") == RDF_TYPE) & (F.col("o.key") == f"U:{node_type}")).select("s").distinct()
            rows = rows.join(typed, "s", "left_semi")
        rdf.write(rows, path, fmt, annotations=latest_annotations(self.store.annotations()) if fmt in rdf.STAR else None)

    def update(self, text: str, read_ts: int | None = None, dry_run: bool = False, author: str = "") -> list[tuple[int, int]]:
        """SPARQL Update: each operation is one commit; the numbers of quads it adds and retracts are returned."""
        out = []
        for op in sparql_parser.parse_update(text, self.vocabulary.prefixes):
            if op.graph_op:
                self._graph_op(op.graph_op, dry_run, author)
                out.append((0, 0))
                continue
            frames = []
            rows = None
            if op.where is not None:
                rows = Sparql(self.snapshot(), self.spark, self.vocabulary.prefixes).group(op.where)
            for template in (op.insert, op.delete):
                frames.append(self._instances(template, rows) if template else None)
            counts = tuple(0 if f is None else f.count() for f in frames)
            out.append(counts)
            if not dry_run and any(counts):
                self.store.apply_changes(*frames, read_ts=read_ts, author=author)
        return out

    def _instances(self, template: list[Pattern], rows: Solutions | None) -> DataFrame:
        parts = []
        for p in template:
            at = lambda t: t.column() if isinstance(t, Value) else F.col(f"`{t.name}`")
            g = F.col(f"`{p.graph.var}`")["str"] if p.graph.var else F.lit(p.graph.iris[0] if p.graph.iris else "")
            base = self.spark.range(1) if rows is None else rows.df
            row = base.select(g.alias("g"), at(p.s)["str"].alias("s"), at(p.p)["str"].alias("p"), at(p.o).alias("o"))
            parts.append(row.where("g is not null and s is not null and p is not null and o is not null"))
        return reduce(DataFrame.unionByName, parts).withColumn("k", F.col("o.key")).dropDuplicates(["g", "s", "p", "k"]).drop("k")

    def _graph_op(self, op: tuple, dry_run: bool, author: str) -> None:
        name, source, target, _ = op
        if dry_run:
            return
        if name == "CREATE":
            self.store.create_graph(source, author)
        elif name in ("CLEAR", "DROP"):
            graphs = [source] if source not in ("ALL", "NAMED") else [r[0] for r in self.store.live().select("g").distinct().toLocalIterator() if source == "ALL" or r[0]]
            if graphs:
                self.store.drop_graph(graphs, author)
        else:
            self.store.copy_graph(source, target, name.lower(), author)

    def _cypher_write(self, tree: cypher.Query, params: dict) -> DataFrame:
        """CREATE, MERGE, SET and DELETE once per matched row (once if nothing is matched), as one commit.

        MERGE takes the least node that has the label and all properties; if there is none, one is made
        for all rows. The numbers of quads that are created, set and deleted are returned.
        """
        run = Cypher(self.snapshot(), self.spark, self.vocabulary)
        expand, graph = self.vocabulary.expand, tree.graph or ""
        read_ts = self.store.last()
        matched = run.bindings(tree, params) if tree.nodes or tree.paths else None
        scratch = Scratch(self.spark, "write")
        base = self.spark.range(1) if matched is None else scratch.save(matched.df, "matched")
        adds, gone, sets = [], [], []
        quad = lambda df, s, p, o: df.select(F.lit(graph).alias("g"), s.alias("s"), F.lit(p).alias("p"), o.alias("o"))
        for w in tree.writes:
            if w[0] in ("CREATE", "MERGE"):
                known = {} if matched is None else {v: F.col(f"`{v}`")["str"] for v in matched.vars}
                rows = list(known.values())
                for var, (label, props) in w[1].items():
                    values = {k: run.constant(v, params) for k, v in props.items()}
                    given = values.pop("id", None)
                    # an id of its own is the hash of what makes the node, so a retried task makes the same
                    content = F.concat_ws("|", F.lit(f"{read_ts}|{var}|{label}|{sorted((k, str(v.value)) for k, v in values.items())}"), *(rows if w[0] == "CREATE" else ()))
                    iri = F.lit(given.value) if given else F.concat(F.lit("urn:uuid:"), F.substring(F.sha2(content, 256), 1, 32))
                    new = F.lit(True)
                    if w[0] == "MERGE" and not given:
                        test = [Pattern(Var("n"), Value("U", RDF_TYPE), Value("U", expand(label)))] if label else []
                        test += [Pattern(Var("n"), Value("U", expand(k)), v) for k, v in values.items()]
                        found = Builder(self.snapshot(), self.spark).conjunction(test).df.agg(F.min(F.col("n")["str"]).alias(f"__found_{var}"))
                        base = base.crossJoin(found)  # one row
                        new, iri = F.col(f"__found_{var}").isNull(), F.coalesce(F.col(f"__found_{var}"), iri)
                    known[var] = iri
                    adds += [quad(base.where(new), iri, RDF_TYPE, Value("U", expand(label)).column())] if label else []
                    adds += [quad(base.where(new), iri, expand(k), v.column()) for k, v in values.items()]
                adds += [quad(base, known[a], expand(kind), terms.node(known[b])) for a, kind, b, _, _ in w[2]]
            elif w[0] == "SET":
                sets.append(quad(base, F.col(f"`{w[1]}`")["str"], expand(w[2]), run.constant(w[3], params).column()))
            else:
                nodes = base.select(F.col(f"`{w[1]}`")["str"].alias("n")).distinct()
                gone.append(self.store.live().where(F.col("g") == graph).join(nodes, F.col("s") == F.col("n"), "left_semi").select("g", "s", "p", "o"))

        def union(parts: list[DataFrame], name: str) -> DataFrame | None:
            if not parts:
                return None
            rows = reduce(DataFrame.unionByName, parts).withColumn("k", F.col("o.key")).dropDuplicates(["g", "s", "p", "k"]).drop("k")
            return scratch.save(rows, name)

        frames = [union(parts, name) for parts, name in ((adds, "adds"), (sets, "sets"), (gone, "gone"))]
        counts = tuple(0 if f is None else f.count() for f in frames)
        if any(counts):
            self.store.commit(*(f if n else None for f, n in zip((frames[0], frames[2]), (counts[0], counts[2]), strict=True)), replaces=frames[1] if counts[1] else None)
        scratch.drop()
        return self.spark.createDataFrame([counts], "created int, set int, deleted int")

    # --- types -----------------------------------------------------------------------------------

    def register(self, registry: Registry, author: str = "") -> int:
        """Stores the types in a graph of their own, in place of those before, and prunes by them."""
        new = rdf.quads_of(self.spark, [(TYPES, *r[1:]) for r in registry.triples()]).select("g", "s", "p", "o")
        old = self.store.live().where(F.col("g") == TYPES).select("g", "s", "p", "o")
        key = ["g", "s", "p", "k"]
        with_key = lambda df: df.withColumn("k", F.col("o.key"))
        gone = with_key(old).join(with_key(new).select(*key), key, "left_anti").drop("k")
        self.registry = registry
        return self.store.commit(new, gone, author=author)

    def registered(self) -> Registry:
        """The stored types; the graph that holds them has one row a fact of the schema."""
        rows = self.store.live().where(F.col("g") == TYPES).select("g", "s", "p", "o").collect()
        return Registry.from_triples([(r.g, r.s, r.p, Value(r.o.kind, r.o.str)) for r in rows])

    def validate_types(self, subjects: DataFrame | None = None) -> DataFrame:
        """Violations of the registered types among live quads, or of some subjects ``(s)``."""
        found = (self.registry or self.registered()).validate(self.store.live().where(F.col("g") != TYPES), self.store.annotations())
        return found if subjects is None else found.join(subjects.select(F.col("s").alias("subject")).distinct(), "subject", "left_semi")

    # --- inference and shapes ------------------------------------------------------------------

    def materialize(self, author: str = "inference", whole: bool = False) -> tuple[int, int]:
        """Brings inferred quads up to date; how many were asserted and closed. A second run does nothing.

        What changed since the last run comes from the change log, and only what follows from it is
        worked out again, unless the schema changed, quads were loaded in bulk, or the log was pruned.
        """
        upto = self.store.last()
        entries = self.store.log()
        done = next((e for e in reversed(entries) if "inferred" in e), None)
        since = [e for e in entries if done and e["ts"] > done["inferred"] and e is not done]
        if done and not any(e["parts"] for e in since if e["ts"] <= upto) and not whole:
            return 0, 0
        live = self.store.live()
        known = done is not None and not whole and self.store.floor() <= done["inferred"] and not any("quads" in e["parts"] and "changes" not in e["parts"] for e in since)
        wanted = self._inferred_from_log(done["inferred"], live) if known else None
        if wanted is None:
            wanted = owl.materialize(live.select("g", "s", "p", "o"))
        scratch = Scratch(self.spark, "materialize")
        add, close = (scratch.save(df, name) for df, name in zip(owl.difference(wanted, live), ("add", "close"), strict=True))
        counts = add.count(), close.count()
        self.store.commit(add if counts[0] else None, close if counts[1] else None, author=author, inferred=upto)
        scratch.drop()
        return counts

    def _inferred_from_log(self, after: int, live: DataFrame) -> DataFrame | None:
        """What should be inferred now, by what changed after a commit; None if the schema did."""
        events = changes.batch(self.store, after).where(F.col("kind").isin("assert", "close") & ~F.col("g").startswith(INFERRED))
        scratch = Scratch(self.spark, "inference-log")
        touched = scratch.save(events.select("g", "s", "p", "o").withColumn("k", F.col("o.key")).dropDuplicates(["g", "s", "p", "k"]), "touched")
        if not touched.where(owl.is_schema()).isEmpty():
            return None
        on = ["g", "s", "p", "k"]
        base = self.store.live(tt=after).where(~F.col("g").startswith(INFERRED)).withColumn("k", F.col("o.key"))
        now = live.where(~F.col("g").startswith(INFERRED)).withColumn("k", F.col("o.key"))
        had, has = touched.join(base.select(*on), on, "left_semi"), touched.join(now.select(*on), on, "left_semi")
        added, deleted = (scratch.save(df.drop("k"), name) for df, name in ((has.join(had, on, "left_anti"), "added"), (had.join(has, on, "left_anti"), "deleted")))
        inferred = live.where(F.col("g").startswith(INFERRED)).select("g", "s", "p", "o")
        return owl.incremental(base.drop("k").select("g", "s", "p", "o"), inferred, added, deleted)

    def validate_shapes(self, shapes: str, adds: DataFrame | None = None, retracts: DataFrame | None = None) -> DataFrame:
        return shacl.validate(rdf.parse_turtle(shapes), self.store.live().where(~F.col("g").startswith(INFERRED)), adds, retracts)
