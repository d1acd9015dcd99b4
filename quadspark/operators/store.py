"""A bitemporal store in a folder: append-only versions, a commit log, optimistic commits.

``quads/``, ``annotations/``, ``vectors/`` and so on hold Parquet in one folder a commit, named at random;
``log/`` holds one small file a commit, made without overwriting, so of two writers of one commit number
the first wins and nothing of the other is ever read. Readers list the log: a job that died half-way
leaves nothing visible. Events of the change feed are written aside and moved to ``changes/`` once their
commit stands, by the writer or by whoever looks next.

``compact`` merges what commits wrote into one folder, sorted by predicate and subject so that row groups
of other predicates are skipped, with the state apart in it: the last version of each quad. A read
of what is live now is then a scan of the state, without a shuffle; commits since are laid on top.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadspark.functions import terms
from quadspark.functions.terms import Value
from quadspark.operators import access, vectors
from quadspark.operators.snapshot import END, QUAD_DDL, Snapshot, edge_id, gram_hits, last_versions, live_rows, resolve, retain, text_search, trigrams
from quadspark.scratch import Scratch

ANNOTATION_DDL = f"edge_id string, g string, p string, o {terms.TERM_DDL}, vt_start bigint, vt_end bigint, tt bigint"
CHANGE_DDL = f"commit_ts bigint, author string, kind string, g string, s string, p string, o {terms.TERM_DDL}"
VECTOR_DDL = "space string, node string, vec array<float>, tt bigint"
GRANT_DDL = "who string, graph string, level string, op string, tt bigint"
MEMBER_DDL = "user string, grp string, op string, tt bigint"
COUNTER_DDL = "namespace string, node string, delta bigint, tt bigint"
COLS = ["g", "s", "p", "o", "edge_id", "vt_start", "vt_end", "tt"]
KEY = ["g", "s", "p", "key"]
MAX_CHANGES = 100_000
#: Predicates with several values of a subject are listed with the state up to this many.
MAX_MANY = 1_000
#: Bytes of Parquet that a compaction sorts in one task.
RANGE_BYTES = 8 << 20


class Conflict(Exception):
    """Another commit wrote what this one wants to write since it read."""


class Expired(Exception):
    """A transaction was left open for longer than it may be."""


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _of(quads: DataFrame, predicate: str | None) -> DataFrame:
    return quads if predicate is None else quads.where(F.col("p") == predicate)


class Store:
    def __init__(self, spark: SparkSession, path: str, clock: Callable[[], int] | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.clock = clock or (lambda: time.time_ns() // 1000)
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()
        self._known: dict[str, dict] = {}  # log entries never change, so each is read once
        self._centres: dict[str, np.ndarray] = {}

    # --- the log -------------------------------------------------------------------------------

    def _fs(self, path: str):
        p = self._fs_path(path)
        return p.getFileSystem(self._conf), p

    def _names(self) -> list[str]:
        fs, p = self._fs(f"{self.path}/log")
        return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []

    def log(self) -> list[dict]:
        """Commits in order. An entry that its writer did not finish is none."""
        for name in self._names():
            if name not in self._known:
                fs, p = self._fs(f"{self.path}/log/{name}")
                source = fs.open(p)
                try:
                    self._known[name] = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
                except ValueError:
                    continue
                finally:
                    source.close()
        return sorted(self._known.values(), key=lambda e: (e["ts"], e["id"]))

    def last(self) -> int:
        return max((e["ts"] for e in self.log()), default=0)

    def _begin(self) -> tuple[int, int, str]:
        """Number, timestamp and folder name of a new commit; the name is no other writer's."""
        number = len(self._names())
        return number, max(self.last() + 1, self.clock()), f"{number:012d}-{uuid.uuid4().hex}"

    def _enter(self, entry: dict, number: int) -> None:
        fs, p = self._fs(f"{self.path}/log/{number:012d}.json")
        try:
            out = fs.create(p, False)
        except Exception as e:  # py4j wraps FileAlreadyExistsException
            raise Conflict(f"commit {number} was made by another writer") from e
        out.write(json.dumps(entry).encode())
        out.close()

    def _write(self, df: DataFrame, kind: str, ident: str) -> None:
        df.write.mode("errorifexists").parquet(f"{self.path}/{kind}/{ident}")

    def _compaction(self) -> dict | None:
        return next((e for e in reversed(self.log()) if "state" in e), None)

    def _read(self, kind: str, ddl: str, after: int | None = None, upto: int | None = None) -> DataFrame:
        """What commits wrote of a kind: past ``after`` and up to ``upto``, where given."""
        within = lambda ts: (after is None or ts > after) and (upto is None or ts <= upto)
        paths = [f"{self.path}/{kind}/{e['id']}" for e in self.log() if kind in e["parts"] and within(e["ts"])]
        return self.spark.read.schema(ddl).parquet(*paths) if paths else self.spark.createDataFrame([], ddl)

    def versions(self, upto: int | None = None) -> DataFrame:
        """All versions, or those of commits up to a timestamp (not before the last compaction)."""
        base = self._compaction()
        if base is None:
            return self._read("quads", QUAD_DDL, upto=upto)
        merged = self._folded(base, 0)
        return merged.unionByName(self._read("quads", QUAD_DDL, base["covers"], upto)) if self._since(base) else merged

    def _folded(self, base: dict, least: int = 1) -> DataFrame:
        """The state that a compaction left; with 0 all of its versions."""
        if not base["state"].get("folded"):  # written in two folders by earlier releases
            return self.spark.read.schema(QUAD_DDL).parquet(f"{self.path}/{'state' if least else 'merged'}/{base['id']}")
        rows = self.spark.read.schema(f"{QUAD_DDL}, last int").parquet(f"{self.path}/merged/{base['id']}")
        return (rows.where(F.col("last") >= least) if least else rows).select(*COLS)

    def _bytes(self, base: dict | None) -> int:
        """Size of what :meth:`versions` reads."""
        folders = [f"quads/{e['id']}" for e in self.log() if "quads" in e["parts"] and (base is None or e["ts"] > base["covers"])]
        folders += [f"merged/{base['id']}"] if base else []
        return sum(fs.getContentSummary(p).getLength() for fs, p in (self._fs(f"{self.path}/{folder}") for folder in folders))

    def _since(self, base: dict) -> bool:
        return any("quads" in e["parts"] and e["ts"] > base["covers"] for e in self.log())

    def annotations(self) -> DataFrame:
        return self._read("annotations", ANNOTATION_DDL)

    def changes(self) -> DataFrame:
        """Events of all commits that the feed still has."""
        self.publish()
        return self._read("changes", CHANGE_DDL, after=self.floor())

    def vectors(self) -> DataFrame:
        """The newest vector of each node in each space."""
        return self._newest()

    def dims(self) -> dict[str, int]:
        """Length of the vectors of each space, as its first commit declared it."""
        out: dict[str, int] = {}
        for e in self.log():
            for space, n in e.get("dims", {}).items():
                out.setdefault(space, n)
        return out

    def state(self) -> DataFrame:
        """The last version of each quad over all time: the compacted state, and commits since on top."""
        base = self._compaction()
        if base is None:
            return last_versions(self.versions())
        state = self._folded(base)
        if not self._since(base):
            return state
        fresh = self._read("quads", QUAD_DDL, base["covers"])
        return self._laid(state, fresh)

    def _laid(self, state: DataFrame, fresh: DataFrame) -> DataFrame:
        """A state with later versions on top: only quads that these touch are resolved again."""
        keyed = state.withColumn("key", F.col("o.key"))
        touched = fresh.select("g", "s", "p", F.col("o.key").alias("key")).distinct()
        old = keyed.join(touched, KEY, "left_semi").select(*COLS)
        return keyed.join(touched, KEY, "left_anti").select(*COLS).unionByName(last_versions(old.unionByName(fresh)).select(*COLS))

    def live(self, vt: int | None = None, tt: int | None = None) -> DataFrame:
        return live_rows(self.state()) if vt is None and tt is None else resolve(self.versions(), vt, tt)

    def snapshot(self, vt: int | None = None, tt: int | None = None) -> Snapshot:
        """Live quads. Bound terms and graphs reach the scans: they are part of what a quad is, so its
        versions are picked before they are resolved. What is live now comes from the state."""
        notes = self.annotations() if tt is None else self.annotations().where(F.col("tt") <= tt)
        base = self._compaction()
        if vt is not None or tt is not None or base is None:
            versions = self.versions()
            return Snapshot(lambda p: resolve(_of(versions, p), vt, tt), annotations=notes, picked=lambda p, test: resolve(_of(versions, p).where(test), vt, tt))
        state = self._folded(base)
        if not self._since(base):
            many = base["state"]["many"]
            return Snapshot(lambda p: live_rows(_of(state, p)), one_graph=base["state"]["one_graph"], single=many is not None, many=frozenset(many or ()), annotations=notes)
        fresh = self._read("quads", QUAD_DDL, base["covers"])
        laid = lambda p, test: live_rows(self._laid(_of(state, p).where(test), _of(fresh, p).where(test)))
        return Snapshot(lambda p: laid(p, F.lit(True)), annotations=notes, picked=laid)

    # --- commits -------------------------------------------------------------------------------

    def commit(
        self,
        adds: DataFrame | None = None,
        retracts: DataFrame | None = None,
        annotations: DataFrame | None = None,
        vectors: DataFrame | None = None,
        mode: str = "add",
        read_ts: int | None = None,
        author: str = "",
        graph_op: tuple[str, str] | list[tuple[str, str]] | None = None,
        versions: DataFrame | None = None,
        replaces: DataFrame | None = None,
        **meta,
    ) -> int:
        """One atomic commit; its timestamp is returned.

        ``adds (g, s, p, o[, vt_start[, vt_end]])`` are written in a mode: add leaves open values of the
        same subject, predicate and graph, replace closes them where the new one starts, auto replaces
        properties that have an open value. ``replaces`` are further additions, in the mode auto.
        ``retracts (g, s, p, o[, vt_end])`` close live quads. ``versions`` are written as they are but for
        their time. ``read_ts`` is what the writer saw: :class:`Conflict` is raised if a later commit wrote
        the same quads (with replace, the same values). Vectors must have the length of their space, which
        its first ones set. ``meta`` goes into the log entry.
        """
        if mode not in ("add", "replace", "auto"):
            raise ValueError(f"unknown mode {mode!r}")
        number, ts, ident = self._begin()
        scratch = Scratch(self.spark, "commit")
        every = self.versions()
        parts: list[DataFrame] = []
        changed: list[DataFrame] = []
        for new, how in ((adds, mode), (replaces, "auto")):
            if new is None:
                continue
            for name, default in (("vt_start", F.lit(ts)), ("vt_end", F.lit(END)), ("edge_id", F.when(F.col("o.kind") == "U", edge_id(F.col("s"), F.col("p"), F.col("o.key"))))):
                new = new.withColumn(name, F.coalesce(name, default)) if name in new.columns else new.withColumn(name, default)
            new = scratch.save(new.withColumn("tt", F.lit(ts)).select(*COLS), f"new-{how}-{len(parts)}")
            self._check(new, every, read_ts, how != "add")
            parts.append(new)
            changed.append(new.withColumn("kind", F.lit("assert")))
            if how != "add":
                closed = scratch.save(self._replaced(new, self._near(every, new, ts), how).withColumn("tt", F.lit(ts)).select(*COLS), f"closed-{len(parts)}")
                parts.append(closed)
                changed.append(closed.withColumn("kind", F.lit("close")))
        if retracts is not None:
            retracts = scratch.save(retracts, "retracts")
            self._check(retracts, every, read_ts, False)
            end = F.coalesce("r_end", F.lit(ts)) if "vt_end" in retracts.columns else F.lit(ts)
            keys = retracts.select("g", "s", "p", F.col("o.key").alias("k"), *([F.col("vt_end").alias("r_end")] if "vt_end" in retracts.columns else []))
            hit = self._near(every, retracts, ts).withColumn("k", F.col("o.key")).join(keys.dropDuplicates(["g", "s", "p", "k"]), ["g", "s", "p", "k"])
            gone = scratch.save(hit.withColumn("vt_end", end).withColumn("tt", F.lit(ts)).select(*COLS), "gone")
            parts.append(gone)
            changed.append(gone.withColumn("kind", F.lit("close")))
        if versions is not None:
            given = scratch.save(versions.withColumn("tt", F.lit(ts)).select(*COLS), "given")
            parts.append(given)
            changed.append(given.withColumn("kind", F.when(F.col("vt_end") == END, "assert").otherwise("close")))
        written = []

        def write(df: DataFrame, kind: str, folder: str | None = None) -> None:
            self._write(df, folder or kind, ident)
            written.append(kind)

        if parts:
            write(_union(parts).sortWithinPartitions("p", "s"), "quads")
        if annotations is not None:
            stamp = annotations.withColumn("tt", F.lit(ts)).withColumn("vt_start", F.lit(ts)).withColumn("vt_end", F.lit(END))
            write(stamp.select(*[c.split()[0] for c in ("edge_id", "g", "p", "o", "vt_start", "vt_end", "tt")]), "annotations")
        if vectors is not None:
            meta |= {"dims": self._dims(vectors)}
            write(vectors.select("space", "node", F.col("vec").cast("array<float>").alias("vec"), F.lit(ts).alias("tt")), "vectors")
        graph_ops = [graph_op] if isinstance(graph_op, tuple) else graph_op or []
        ops = [self.spark.createDataFrame(graph_ops, "kind string, g string").select("kind", "g", *[F.lit(None).cast(t).alias(n) for n, t in (("s", "string"), ("p", "string"))], F.lit(None).cast(terms.TERM).alias("o"))] if graph_ops else []
        rows = [c.select("kind", "g", "s", "p", "o") for c in changed] + ops
        if rows:
            events = _union(rows).select(F.lit(ts).alias("commit_ts"), F.lit(author).alias("author"), "kind", "g", "s", "p", "o")
            write(events, "changes", "changes/_staged")
        self._enter({"ts": ts, "id": ident, "parts": written, "author": author, **({"graphs": graph_ops} if graph_ops else {}), **meta}, number)
        scratch.drop()
        self.publish()
        return ts

    def _near(self, every: DataFrame, rows: DataFrame, ts: int) -> DataFrame:
        """What is live at ``ts`` of the subjects and predicates of ``rows``, and no more of the store."""
        heads = rows.select("g", "s", "p").distinct()
        return resolve(every.join(heads, ["g", "s", "p"], "left_semi"), vt=ts)

    def _replaced(self, new: DataFrame, live: DataFrame, mode: str) -> DataFrame:
        """Closing versions of open values that new ones of the same subject, predicate and graph replace."""
        heads = new.where(F.col("o.kind") != "U") if mode == "auto" else new
        heads = heads.groupBy("g", "s", "p").agg(F.min("vt_start").alias("from"), F.collect_set("o.key").alias("keys"))
        hit = live.where(F.col("vt_end") == END).join(heads, ["g", "s", "p"])
        return hit.where(~F.array_contains("keys", F.col("o.key"))).withColumn("vt_end", F.greatest("from", "vt_start"))

    def _check(self, rows: DataFrame, every: DataFrame, read_ts: int | None, whole: bool) -> None:
        if read_ts is None:
            return
        on = ["g", "s", "p"] if whole else ["g", "s", "p", "k"]
        keys = rows.withColumn("k", F.col("o.key")).select(*on).distinct()
        later = every.where(F.col("tt") > read_ts).withColumn("k", F.col("o.key"))
        if not later.join(keys, on, "left_semi").limit(1).isEmpty():
            raise Conflict("a later commit wrote the same")

    def _dims(self, rows: DataFrame) -> dict[str, int]:
        """Lengths of new spaces; an error if a vector has another length than its space."""
        known = self.dims()
        fresh = rows.where(~F.col("space").isin(*known)) if known else rows
        new = {r[0]: r[1] for r in fresh.groupBy("space").agg(F.min(F.size("vec"))).collect()}
        wrong = vectors.check_dims(rows, known | new).first()
        if wrong:
            raise ValueError(f"{wrong.node} has {wrong.dims} components, space {wrong.space} has {wrong.expected}")
        return new

    def publish(self) -> None:
        """Moves events of commits that stand to where the feed is read."""
        staged = f"{self.path}/changes/_staged"
        fs, p = self._fs(staged)
        if not fs.exists(p):
            return
        there = {f.getPath().getName() for f in fs.listStatus(p)}
        for e in self.log():
            if e["id"] in there:
                fs.rename(self._fs_path(f"{staged}/{e['id']}"), self._fs_path(f"{self.path}/changes/{e['id']}"))

    # --- what is built on commits ----------------------------------------------------------------

    def apply_changes(self, adds: DataFrame | None, retracts: DataFrame | None, read_ts: int | None = None, author: str = "", annotations: DataFrame | None = None, everywhere: DataFrame | None = None) -> int:
        """Additions and retractions of any graphs, and annotations ``(edge_id, g, p, o)`` on edges, as
        one commit of bounded length. ``everywhere (s, p, o)`` is retracted from every graph that has it."""
        if everywhere is not None:
            keys = everywhere.select("s", "p", F.col("o.key").alias("key"))
            found = self.live().withColumn("key", F.col("o.key")).join(keys, ["s", "p", "key"], "left_semi").select("g", "s", "p", "o")
            retracts = found if retracts is None else retracts.select("g", "s", "p", "o").unionByName(found)
        n = sum(d.count() for d in (adds, retracts, annotations) if d is not None)
        if n > MAX_CHANGES:
            raise ValueError(f"{n} changes; a change set has {MAX_CHANGES} at most, bulk loads use bulk_load")
        return self.commit(adds, retracts, annotations, read_ts=read_ts, author=author)

    def bulk_load(self, quads: DataFrame) -> int:
        """Appends quads past checks and the change log, as one plain write."""
        number, ts, ident = self._begin()
        rows = quads.withColumn("vt_start", F.lit(ts)).withColumn("vt_end", F.lit(END)).withColumn("tt", F.lit(ts))
        self._write(rows.select(*COLS), "quads", ident)
        self._enter({"ts": ts, "id": ident, "parts": ["quads"], "author": ""}, number)
        return ts

    def delete(self, subject: str, predicate: str | None = None, o: Value | None = None, graph: str | None = None, author: str = "") -> int:
        rows = self.live().where(F.col("s") == subject)
        rows = rows if predicate is None else rows.where(F.col("p") == predicate)
        rows = rows if o is None else rows.where(F.col("o.key") == o.key())
        rows = rows if graph is None else rows.where(F.col("g") == graph)
        return self.commit(retracts=rows.select("g", "s", "p", "o"), author=author)

    def create_graph(self, graph: str, author: str = "", **metadata) -> int:
        """A graph that exists without quads; ``metadata`` is kept with it."""
        return self.commit(graph_op=("graph-created", graph), author=author, graph_metadata={graph: metadata})

    def drop_graph(self, graph: str | list[str], author: str = "") -> int:
        """Closes all quads of one graph, or of several, in one commit."""
        names = [graph] if isinstance(graph, str) else graph
        live = self.live()
        at = max(self.last() + 1, self.clock())
        rows = _union([access.drop_graph(live, name, at, at) for name in names])
        return self.commit(versions=rows, graph_op=[("graph-dropped", name) for name in names], author=author)

    def copy_graph(self, source: str, target: str, how: str = "copy", author: str = "") -> int:
        """``how`` is add, copy (clears the target) or move (and drops the source)."""
        live = self.live()
        at = max(self.last() + 1, self.clock())
        rows = access.move_graph(live, source, target, at, at) if how == "move" else access.copy_graph(live, source, target, at, at, how == "copy")
        return self.commit(versions=rows, graph_op=("graph-copied", target), author=author)

    def graphs(self) -> DataFrame:
        """``(g, quads, last_tt, metadata)``: graphs that hold quads, and those created and not dropped since."""
        open_graphs: dict[str, bool] = {}
        metadata: dict[str, dict] = {}
        for e in self.log():
            metadata |= e.get("graph_metadata", {})
            for kind, g in e.get("graphs", []):
                open_graphs[g] = kind != "graph-dropped"
        rows = [(g, json.dumps(metadata.get(g, {}))) for g in {*metadata, *open_graphs} if open_graphs.get(g)]
        made = self.spark.createDataFrame(rows, "g string, metadata string")
        held = access.stats(self.live())
        out = held.join(made, "g", "full_outer")
        return out.select("g", F.coalesce("quads", F.lit(0)).alias("quads"), "last_tt", F.coalesce("metadata", F.lit("{}")).alias("metadata"))

    # --- grants, groups and counters, stored --------------------------------------------------------

    def _append(self, kind: str, rows: list[tuple], ddl: str, author: str) -> int:
        number, ts, ident = self._begin()
        self._write(self.spark.createDataFrame([(*r, ts) for r in rows], ddl), kind, ident)
        self._enter({"ts": ts, "id": ident, "parts": [kind], "author": author}, number)
        return ts

    def _latest(self, kind: str, ddl: str, key: list[str]) -> DataFrame:
        rows = self._read(kind, ddl)
        others = [c.split()[0] for c in ddl.split(", ") if c.split()[0] not in (*key, "tt")]
        last = rows.groupBy(*key).agg(F.max(F.struct("tt", *others)).alias("x"))
        return last.where("x.op = 'set'").select(*key, *[f"x.{c}" for c in others if c != "op"])

    def grant(self, who: str, graph: str, level: str, author: str = "") -> int:
        if level not in access.LEVELS:
            raise ValueError(f"unknown level {level!r}")
        return self._append("grants", [(who, graph, level, "set")], GRANT_DDL, author)

    def revoke(self, who: str, graph: str, author: str = "") -> int:
        return self._append("grants", [(who, graph, None, "unset")], GRANT_DDL, author)

    def add_to_group(self, user: str, group: str, author: str = "") -> int:
        return self._append("members", [(user, group, "set")], MEMBER_DDL, author)

    def remove_from_group(self, user: str, group: str, author: str = "") -> int:
        return self._append("members", [(user, group, "unset")], MEMBER_DDL, author)

    def grants(self) -> DataFrame:
        return self._latest("grants", GRANT_DDL, ["who", "graph"]).select("who", "graph", "level")

    def members(self) -> DataFrame:
        return self._latest("members", MEMBER_DDL, ["user", "grp"]).select("user", "grp")

    def increment(self, deltas: list[tuple[str, str, int]], author: str = "") -> int:
        """Adds to counters ``(namespace, node)``; increments of any writers add up."""
        return self._append("counters", deltas, COUNTER_DDL, author)

    def counters(self) -> DataFrame:
        return access.counters(self._read("counters", COUNTER_DDL))

    # --- the text index ------------------------------------------------------------------------------

    def index_text(self, author: str = "") -> int:
        """Writes the trigrams of all live short literals, sorted, so that a search reads those of its query
        only. Searches use it until quads are committed after it."""
        covers, ident = self.last(), f"t-{uuid.uuid4().hex}"
        self._write(trigrams(self.live()).repartitionByRange("gram").sortWithinPartitions("gram"), "text", ident)
        number, ts, _ = self._begin()
        self._enter({"ts": ts, "id": ident, "parts": [], "author": author, "text": covers}, number)
        return ts

    def search_text(self, query: str, predicate: str | None = None) -> DataFrame:
        """Live literals that contain the query, in whatever case: by the index if it is up to date and the
        query has three characters, else by a scan."""
        index = next((e for e in reversed(self.log()) if "text" in e), None)
        rows = _of(self.live(), predicate)
        if index and len(query) >= 3 and not any("quads" in e["parts"] and e["ts"] > index["text"] for e in self.log()):
            hits = gram_hits(self.spark.read.parquet(f"{self.path}/text/{index['id']}"), query, predicate)
            rows = rows.withColumn("key", F.col("o.key")).join(hits, KEY, "left_semi").drop("key")
        return text_search(rows, query, predicate)

    # --- the vector index ----------------------------------------------------------------------------

    def index_vectors(self, space: str, author: str = "") -> int:
        """Builds the index of a space from its newest vectors. Vectors committed later are searched
        beside it, exactly, until it is built again."""
        covers = self.last()
        ident = f"v-{uuid.uuid4().hex}"
        own = self._newest(covers).where(F.col("space") == space).select("node", "vec")
        scratch = Scratch(self.spark, "vectors")

        def save(df: DataFrame, name: str) -> DataFrame:
            self._write(df, f"ann/{name}", ident)
            return self.spark.read.schema(vectors.INDEX_DDL).parquet(f"{self.path}/ann/{name}/{ident}")

        built = vectors.build_cells(scratch.save(own, "newest"), save)
        number, ts, _ = self._begin()
        facts: dict = {"covers": covers}
        if built:
            _, centres, visits = built
            rows = [(n, c.tolist()) for n, c in enumerate(centres)]
            self._write(self.spark.createDataFrame(rows, "cell int, centre array<double>").coalesce(1), "ann/centres", ident)
            facts |= {"index": ident, "visits": visits, "cells": len(centres)}
        self._enter({"ts": ts, "id": ident, "parts": [], "author": author, "ann": {space: facts}}, number)
        scratch.drop()
        return ts

    def _newest(self, upto: int | None = None, after: int | None = None) -> DataFrame:
        rows = self._read("vectors", VECTOR_DDL, after, upto)
        return rows.groupBy("space", "node").agg(F.max_by("vec", "tt").alias("vec"))

    def nearest(self, space: str, query: list[float], k: int, ef: int | None = None, allowed: DataFrame | None = None, exact: bool = False) -> DataFrame:
        """``(node, score)``: the k nearest of a space by cosine, ties to smaller nodes, among
        ``allowed (node)`` if given. By the index where there is one, with vectors since on top."""
        facts = next((e["ann"][space] for e in reversed(self.log()) if space in e.get("ann", {})), None)
        if exact or facts is None or "index" not in facts:
            return vectors.top_k(self.vectors(), query, k, space, allowed)
        ident = facts["index"]
        index = self.spark.read.schema(vectors.INDEX_DDL).parquet(f"{self.path}/ann/index/{ident}")
        if ident not in self._centres:
            got = self.spark.read.parquet(f"{self.path}/ann/centres/{ident}").orderBy("cell").collect()  # at most MAX_CELLS
            self._centres[ident] = np.array([r.centre for r in got])
        if not any("vectors" in e["parts"] and e["ts"] > facts["covers"] for e in self.log()):
            return vectors.search_cells(index, self._centres[ident], facts["visits"], query, k, ef, allowed)
        fresh = self._newest(after=facts["covers"]).where(F.col("space") == space)
        index = index.join(fresh.select("node"), "node", "left_anti")
        old = vectors.search_cells(index, self._centres[ident], facts["visits"], query, k, ef, allowed)
        return old.unionByName(vectors.top_k(fresh, query, k, space, allowed)).orderBy(F.desc("score"), "node").limit(k)

    # --- upkeep -----------------------------------------------------------------------------------

    def compact(self, tx_cutoff: int | None = None, vt_cutoff: int | None = None, author: str = "") -> int:
        """Merges all versions into one sorted folder, the state apart from older versions; with cutoffs only
        what retention leaves. Commits that other writers make meanwhile are not covered, and stay as
        they are. What is merged is deleted by :meth:`vacuum`, so readers in flight are not disturbed."""
        covers = self.last()
        every = self.versions(covers)
        if tx_cutoff is not None or vt_cutoff is not None:
            every = retain(every, tx_cutoff, vt_cutoff)
        ident = f"c-{uuid.uuid4().hex}"
        # one shuffle deals, sorts and tells last versions apart: all that is asked of a quad or a subject's
        # values is within a range. Ids that follow from the quad are not carried through it.
        own = edge_id(F.col("s"), F.col("p"), F.col("o.key"))
        rows = every.select(*COLS).withColumn("edge_id", F.when(F.col("edge_id") == own, F.lit("")).otherwise(F.col("edge_id")))
        rows = rows.repartitionByRange(max(1, -(-self._bytes(self._compaction()) // RANGE_BYTES)), "p", "s")
        rows = rows.withColumn("edge_id", F.when(F.col("edge_id") == "", own).otherwise(F.col("edge_id"))).withColumn("key", F.col("o.key"))
        newest = Window.partitionBy("p", "s", "g", "key").orderBy(*[F.desc(c) for c in ("vt_start", "tt", "vt_end", "edge_id", "o")])
        rows = rows.withColumn("nth", F.row_number().over(newest))
        value = F.when((F.col("nth") == 1) & (F.col("vt_end") == END) & (F.col("o.kind") != "U"), F.col("key"))
        before = Window.partitionBy("p", "s").orderBy("g", "key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        other = value.isNotNull() & ((F.min(value).over(before) != value) | (F.max(value).over(before) != value))
        rows = rows.withColumn("last", F.when(F.col("nth") > 1, 0).when(other, 2).otherwise(1)).select(*COLS, "last")
        # 0 is an older version, 1 a last one, 2 a last one of a subject that has another value
        rows.sortWithinPartitions("last", "p", "s").write.mode("errorifexists").partitionBy("last").parquet(f"{self.path}/merged/{ident}")
        written = self.spark.read.schema(f"{QUAD_DDL}, last int").parquet(f"{self.path}/merged/{ident}")
        low, high = live_rows(written.where("last > 0")).agg(F.min("g"), F.max("g")).first()
        many = [r[0] for r in written.where("last = 2").select("p").distinct().limit(MAX_MANY + 1).collect()]
        number, ts, _ = self._begin()
        facts = {"one_graph": low == high, "many": many if len(many) <= MAX_MANY else None, "folded": True}
        self._enter({"ts": ts, "id": ident, "parts": [], "author": author, "covers": covers, "state": facts}, number)
        return ts

    def vacuum(self, older_seconds: float = 86_400) -> int:
        """Deletes quads that are merged, older compactions, and folders that no commit owns; how many.

        Folders younger than ``older_seconds`` stay: a writer may be about to commit them, a reader in them.
        """
        base, entries = self._compaction(), self.log()
        before = (time.time() - older_seconds) * 1000
        covered = base["covers"] if base else -1
        keep = {kind: {e["id"] for e in entries if kind in e["parts"]} for kind in ("annotations", "vectors", "grants", "members", "counters")}
        keep["quads"] = {e["id"] for e in entries if "quads" in e["parts"] and e["ts"] > covered}
        keep |= {kind: {base["id"]} if base else set() for kind in ("merged", "state")}
        indexes = {space: facts["index"] for e in entries for space, facts in e.get("ann", {}).items() if "index" in facts}
        keep |= {kind: set(indexes.values()) for kind in ("ann/index", "ann/centres")}
        keep["text"] = {next((e["id"] for e in reversed(entries) if "text" in e), None)}
        gone = 0
        for kind, names in keep.items():
            fs, p = self._fs(f"{self.path}/{kind}")
            for f in fs.listStatus(p) if fs.exists(p) else ():
                if f.getPath().getName() not in names and f.getModificationTime() <= before:
                    fs.delete(f.getPath(), True)
                    gone += 1
        return gone

    def floor(self) -> int:
        """The commit that the change feed begins after."""
        return max((e["floor"] for e in self.log() if "floor" in e), default=0)

    def prune_changes(self, upto: int, author: str = "") -> int:
        """Takes events of commits up to a timestamp out of the feed, which then begins after it."""
        self.publish()
        number, ts, ident = self._begin()
        self._enter({"ts": ts, "id": ident, "parts": [], "author": author, "floor": upto}, number)
        for e in self.log():
            if "changes" in e["parts"] and e["ts"] <= upto:
                fs, p = self._fs(f"{self.path}/changes/{e['id']}")
                fs.delete(p, True)
        return ts

    def backup(self, target: str) -> int:
        """Copies what the log names to another folder, the log last, so a copy that broke off is empty;
        it is a store as it stands. Data are copied by the cluster; how many commits is returned."""
        self.publish()
        entries, names, base = self.log(), self._names(), self._compaction()
        covered = base["covers"] if base else -1
        folders = [(kind, e["id"]) for e in entries for kind in e["parts"] if not (kind == "quads" and e["ts"] <= covered) and not (kind == "changes" and e["ts"] <= self.floor())]
        folders += [(kind, base["id"]) for kind in ("merged", "state")] if base else []
        folders += [(kind, facts["index"]) for e in entries for facts in e.get("ann", {}).values() if "index" in facts for kind in ("ann/index", "ann/centres")]
        folders += [("text", e["id"]) for e in entries if "text" in e]
        folders = [(kind, ident) for kind, ident in folders if self._fs(f"{self.path}/{kind}/{ident}")[0].exists(self._fs_path(f"{self.path}/{kind}/{ident}"))]
        for kind, ident in folders:
            self.spark.read.parquet(f"{self.path}/{kind}/{ident}").write.mode("overwrite").parquet(f"{target}/{kind}/{ident}")
        out = Store(self.spark, target, self.clock)
        for name in names:
            if name in self._known:
                fs, p = self._fs(f"{target}/log/{name}")
                file = fs.create(p, True)
                file.write(json.dumps(self._known[name]).encode())
                file.close()
        return len(out.log())

    def begin(self, idle_seconds: float = 300.0) -> Transaction:
        return Transaction(self, idle_seconds)


class Transaction:
    """Buffered changes with the timestamp that was read; nothing is written before commit.

    One that is not used for ``idle_seconds`` has expired: every further use raises :class:`Expired`.
    """

    def __init__(self, store: Store, idle_seconds: float = 300.0):
        self.store, self.read_ts, self.idle = store, store.last(), idle_seconds
        self.adds: list[DataFrame] = []
        self.retracts: list[DataFrame] = []
        self.used = time.monotonic()

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None and (self.adds or self.retracts):
            self.commit()

    def _touch(self) -> None:
        if time.monotonic() - self.used > self.idle:
            self.rollback()
            raise Expired(f"not used for {self.idle} seconds")
        self.used = time.monotonic()

    def add(self, quads: DataFrame) -> None:
        self._touch()
        self.adds.append(quads.select("g", "s", "p", "o"))

    def retract(self, quads: DataFrame) -> None:
        self._touch()
        self.retracts.append(quads.select("g", "s", "p", "o"))

    def snapshot(self) -> Snapshot:
        """What was live when the transaction began, with its own writes on top."""
        from quadspark.operators.snapshot import overlay

        self._touch()
        base = self.store.snapshot(tt=self.read_ts)
        if not self.adds:
            return base
        pending = _union(self.adds)
        return Snapshot(lambda p: overlay(base.source(p).select("g", "s", "p", "o", "edge_id"), (pending if p is None else pending.where(F.col("p") == p)).withColumn("edge_id", F.when(F.col("o.kind") == "U", edge_id(F.col("s"), F.col("p"), F.col("o.key"))))))

    def commit(self, mode: str = "add", author: str = "") -> int:
        self._touch()
        union = lambda parts: _union(parts) if parts else None
        ts = self.store.commit(union(self.adds), union(self.retracts), mode=mode, read_ts=self.read_ts, author=author)
        self.rollback()
        return ts

    def rollback(self) -> None:
        self.adds, self.retracts = [], []
