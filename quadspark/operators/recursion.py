"""Closures and rules to a fixpoint.

Loops are semi-naive: a round joins only what the last round found, and writes it to the scratch
folder, so plans stay short and a lost executor costs one round.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadspark.scratch import Scratch


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def closure(edges: DataFrame, first: DataFrame | None = None) -> DataFrame:
    """``(s, o)``: nodes reached over one edge or more from ``first`` (pairs; all edges if None).

    A start is in its own closure only over a cycle. From a start the frontier moves an edge a round. The
    whole closure doubles: pairs at a distance of up to 2^n come from the newest ones joined to all known,
    so rounds grow with the logarithm of the diameter.
    """
    scratch = Scratch(edges.sparkSession, "closure")
    every = scratch.save(edges.select("s", "o").distinct(), "edges")
    delta = every if first is None else scratch.save(first.select("s", "o").distinct(), "0")
    parts, turn = [delta], 0
    while not delta.isEmpty():
        turn += 1
        known = _union(parts)
        step = (known if first is None else every).select(F.col("s").alias("via"), F.col("o").alias("next"))
        found = delta.join(step, F.col("o") == F.col("via")).select("s", F.col("next").alias("o")).distinct()
        delta = scratch.save(found.join(known, ["s", "o"], "left_anti"), str(turn))
        parts.append(delta)
    return _union(parts[:-1] if len(parts) > 1 else parts)


def bounded(edges: DataFrame, least: int, most: int, first: DataFrame | None = None) -> DataFrame:
    """``(s, o)``: distinct pairs that a walk of ``least`` to ``most`` edges joins (``least`` at least 1)."""
    step = edges.select(F.col("s").alias("via"), F.col("o").alias("next")).distinct()
    walk = (edges if first is None else first).select("s", "o").distinct()
    out = [walk] if least <= 1 else []
    for depth in range(2, most + 1):
        walk = walk.join(step, F.col("o") == F.col("via")).select("s", F.col("next").alias("o")).distinct()
        if depth >= least:
            out.append(walk)
    return _union(out).distinct()


def path(edges: DataFrame, least: int, most: int | None, nodes: Callable[[], DataFrame], start: str | None = None, end: str | None = None) -> DataFrame:
    """``(s, o)`` of a path of ``least`` to ``most`` edges; zero edges join each of ``nodes()`` to itself.

    A bound start (or end, walked backwards) limits the walk from its first step.
    """
    if start is None and end is not None:
        back = path(edges.select(F.col("o").alias("s"), F.col("s").alias("o")), least, most, nodes, start=end)
        return back.select(F.col("o").alias("s"), F.col("s").alias("o"))
    first = None if start is None else edges.where(F.col("s") == start)
    parts = []
    if least == 0:
        same = nodes().select(F.col("n").alias("s"), F.col("n").alias("o"))
        parts.append(same if start is None else edges.sparkSession.createDataFrame([(start, start)], "s string, o string"))
    if most is None:
        begin = first if least <= 1 else bounded(edges, least, least, first)
        parts.append(closure(edges, begin))
    elif most >= 1:
        parts.append(bounded(edges, max(least, 1), most, first))
    out = _union(parts).distinct()
    return out if end is None else out.where(F.col("o") == end)


def fixpoint(scratch: Scratch, heads: set[str], base: Callable[[], dict[str, list[DataFrame]]], step: Callable[[dict, dict], dict[str, list[DataFrame]]]) -> dict[str, DataFrame]:
    """Facts ``(s, o)`` of each head. ``base()`` gives what follows from stored facts alone;
    ``step(known, new)`` what follows with at least one new fact."""
    schema = "s string, o string"
    empty = scratch.spark.createDataFrame([], schema)
    known: dict[str, list[DataFrame]] = {h: [] for h in heads}
    found, turn = base(), 0
    while True:
        new = {}
        for head in sorted(heads):
            rows = found.get(head)
            if not rows:
                continue
            fresh = _union(rows).distinct()
            if known[head]:
                fresh = fresh.join(_union(known[head]), ["s", "o"], "left_anti")
            fresh = scratch.save(fresh, f"{turn}-{sorted(heads).index(head)}")
            if not fresh.isEmpty():
                new[head] = fresh
        if not new:
            return {h: _union(parts) if parts else empty for h, parts in known.items()}
        for head, rows in new.items():
            known[head].append(rows)
        found = step({h: _union(parts) if parts else empty for h, parts in known.items()}, new)
        turn += 1
