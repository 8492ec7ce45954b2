"""Connected components of a link table, wholly on executors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import written


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``n`` nodes by the links (a[i], b[i])."""
    parent = np.arange(n)
    while True:
        pa, pb = parent[a], parent[b]
        open_ = pa != pb
        if not open_.any():
            return parent
        np.minimum.at(parent, np.maximum(pa, pb)[open_], np.minimum(pa, pb)[open_])
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
        a, b = a[open_], b[open_]


def forest(n: int, a: np.ndarray, b: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Positions of the links of a cheapest spanning forest over ``n`` nodes (Boruvka's rounds)."""
    live = np.argsort(cost, kind="stable")
    roots, chosen = np.arange(n), []
    while True:
        live = live[roots[a[live]] != roots[b[live]]]
        if not len(live):
            return np.concatenate(chosen) if chosen else live
        ra, rb = roots[a[live]], roots[b[live]]
        best = np.full(n, len(live))
        np.minimum.at(best, ra, np.arange(len(live)))
        np.minimum.at(best, rb, np.arange(len(live)))
        pick = np.unique(best[best < len(live)])
        chosen.append(live[pick])
        roots = local_roots(n, ra[pick], rb[pick])[roots]


#: Links up to which the rest of a contracted graph is solved in one task (16 bytes a link).
FEW = 500_000


def _solved(links: DataFrame, kind: str) -> DataFrame:
    """``(a, p)`` for the nodes of at most ``FEW`` links, in one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [pdf for pdf in batches if len(pdf)]
        if held:
            whole = pd.concat(held, ignore_index=True)
            nodes, at = np.unique(np.concatenate((whole["a"].to_numpy(), whole["b"].to_numpy())), return_inverse=True)
            yield pd.DataFrame({"a": nodes, "p": nodes[local_roots(len(nodes), at[: len(whole)], at[len(whole) :])]})

    return links.coalesce(1).mapInPandas(run, f"a {kind}, p {kind}")


def connected_components(links: DataFrame, few: int = FEW) -> DataFrame:
    """``(node, root)`` for every node of ``links(a, b)``; root is the smallest node reachable.

    Randomised contraction: in each round every node points at that of itself and its neighbours which
    comes first in an order drawn anew (a hash of node and round), jumps once to where that one points,
    and the links are contracted to the nodes pointed at. Whatever the shape and numbering of the graph, a
    round leaves at most about two thirds of its nodes in expectation, so the rounds grow with the
    logarithm of the number of nodes. What is left of at most ``few`` links is solved in one task. The
    levels are then put together from the smallest up, each written, so no plan grows with the rounds.
    Minima are aggregated before each shuffle and joins have a unique node table on one side, so
    that a hub's rows can be split among tasks. Nothing is collected. Links with a null end are ignored.
    """
    kind = links.schema["a"].dataType.simpleString()
    tidy = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    now = written(tidy(links.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL")), "links")
    levels: list[DataFrame] = []
    while (left_over := now.limit(few + 1).count()) > few:
        order = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(len(levels))).alias("h"), F.col(c).alias("to"))  # noqa: B023, E731
        ends = now.select("a", order("b").alias("o")).union(now.select(F.col("b").alias("a"), order("a").alias("o")))
        first = written(ends.groupBy("a").agg(F.min("o").alias("o")).select("a", F.least(order("a"), F.col("o"))["to"].alias("p")), "hooks")
        above = first.select(F.col("a").alias("x"), F.col("p").alias("q"))
        jumped = written(first.join(above, first["p"] == above["x"]).select("a", F.col("q").alias("p")), "hooks")
        levels.append(jumped)
        left = jumped.select(F.col("a").alias("x"), F.col("p").alias("pa"))
        right = jumped.select(F.col("a").alias("y"), F.col("p").alias("pb"))
        moved = now.join(left, now["a"] == left["x"]).join(right, now["b"] == right["y"])
        now = written(tidy(moved.select(F.col("pa").alias("a"), F.col("pb").alias("b"))), "links")
    if not left_over and not levels:
        return links.sparkSession.createDataFrame([], f"node {kind}, root {kind}")
    roots = written(_solved(now, kind), "roots") if left_over else None
    for k, lower in enumerate(reversed(levels)):
        if roots is not None:
            upper = roots.select(F.col("a").alias("x"), F.col("p").alias("q"))
            lower = lower.join(upper, lower["p"] == upper["x"], "left").select("a", F.coalesce("q", "p").alias("p"))
        roots = written(lower, "roots") if k + 1 < len(levels) else lower
    if not levels:
        return roots.select(F.col("a").alias("node"), F.col("p").alias("root"))
    roots = written(roots, "roots")
    least = roots.groupBy("p").agg(F.min("a").alias("root")).select(F.col("p").alias("group"), "root")
    return roots.join(least, roots["p"] == least["group"]).select(F.col("a").alias("node"), "root")
