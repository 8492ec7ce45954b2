"""Embedding near-dedup with a forest of random-projection trees.

Equal vectors are one class. Trees split the classes at the median of their projections on a random
direction; vectors nearer to the border than ``SPILL`` go to both sides. In each leaf all classes are
compared by cosine in double precision, and links are counted in the first leaf (in the order of trees)
that holds both ends, so nothing is counted twice and no pair leaves its task: a task sends on each
class's number of links and a spanning forest. Components are then the union over all leaves.

The trees are fitted on at most ``SAMPLE`` classes, those whose hash is smallest, and every class goes
down all of them. Where there are more classes than that, leaves that are too large are split on, each by
a tree fitted on a sample of its own, until they are small; these trees are tables, not broadcast. A
vector length that the sample lacks starts with as many trees of one leaf. A node
is a border only: its direction follows from the leaf's number and its own. A leaf that still is too large
(a dense group that no split takes apart) is compared in full in tiles. A pair of cosine 0.9 or more is
missed only if all trees part it. Their number follows from the number of classes (16 up to some
250,000), so that the recall at the threshold stays the same: rows grow with a power of about 1.05
of the input up to there and 1.24 beyond.

Vectors that are null, empty, zero, or hold a null or non-finite component link with nothing, nor do
those with a null vec_id (their component_id is null, kept false). Vectors of different lengths do
not link. Rows are kept one for one; rows that repeat a vec_id with the same vector count as one vector.
An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from math import erfc, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import need, tiled, written
from quillspark.llm.graph import connected_components, forest

COSINE = 0.9
#: Trees at least; and the share of pairs at the very threshold that may be parted by all trees, from
#: which follows how many trees a larger table gets.
TREES, MISSED = 16, 0.001
LEAF = 1024
SAMPLE = 16_384
#: Half the width of the band that goes to both sides, in deviations of the projection of the
#: difference of two unit vectors of the least cosine. Spill multiplies rows at every level: with 0.1 a
#: split keeps 0.518 of the rows on each side, so rows grow by 3.6 % a level, and more trees make up for it.
SPILL = 0.1

#: A split that leaves a share p on each side multiplies rows by 2 p and divides leaves by 1 / p: it costs
#: less than tiles of the whole leaf if 2 p < 1 / p. Beyond that a dense group would double at each level.
WORTH = 0.7
#: In each leaf that is split on, about so many classes are fitted on.
LEAF_SAMPLE = 2048

Tree = list[tuple[float, int, int]]  # border and children of each node; a leaf's children are itself


def trees_for(classes: int, cosine: float = COSINE, leaf: int = LEAF, least: int = TREES, missed: float = MISSED) -> int:
    """Trees by which a pair at the threshold is parted in all with a chance of at most ``missed``.

    For directions that do not know the data, the projections of a pair are two normal numbers with
    the cosine as correlation, of a spread of 1 / sqrt(size): a split parts them if they lie beyond
    the band on both sides.
    """
    band = SPILL * np.sqrt(2 - 2 * cosine)
    x = np.linspace(band, band + 8, 4001)
    tail = np.array([0.5 * erfc((band + cosine * v) / sqrt(2 - 2 * cosine * cosine)) for v in x])
    parted = 2 * float(np.trapezoid(np.exp(-x * x / 2) / np.sqrt(2 * np.pi) * tail, x))
    share = 1 - 0.5 * erfc(band / sqrt(2))
    depth = max(0.0, float(np.log(max(1, classes) / leaf) / -np.log(share)))
    kept = (1 - parted) ** depth
    return max(least, int(np.ceil(np.log(missed) / np.log1p(-kept)))) if kept < 1 - 1e-9 else least


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, in doubles."""
    x = vectors.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _band(cosine: float, size: int) -> float:
    return SPILL * np.sqrt((2 - 2 * cosine) / size)


def _way(seed: int, at: int, size: int) -> np.ndarray:
    way = np.random.default_rng([seed % (1 << 64), at]).standard_normal(size)
    return way / np.linalg.norm(way)


def grow(x: np.ndarray, each: float, cosine: float, leaf: int, seed: int) -> Tree:
    """One tree over the sample ``x``, each row of which stands for ``each`` rows."""
    tree: Tree = []
    band = _band(cosine, x.shape[1])

    def node(rows: np.ndarray) -> int:
        at = len(tree)
        tree.append((0.0, at, at))
        if len(rows) * each > leaf and len(rows) >= 32:
            along = x[rows] @ _way(seed, at, x.shape[1])
            border = float(np.median(along))
            low, high = rows[along <= border + band], rows[along >= border - band]
            if max(len(low), len(high)) < WORTH * len(rows):
                tree[at] = (border, node(low), node(high))
        return at

    node(np.arange(len(x)))
    return tree


def descend(tree: Tree, x: np.ndarray, band: float, seed: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each leaf and the rows that reach it."""
    stack = [(0, np.arange(len(x)))]
    while stack:
        at, rows = stack.pop()
        border, low, high = tree[at]
        if low == at:
            yield at, rows
        elif len(rows):
            along = x[rows] @ _way(seed, at, x.shape[1])
            stack += [(low, rows[along <= border + band]), (high, rows[along >= border - band])]


def split_on(routed: DataFrame, cosine: float, leaf: int, sample: int) -> DataFrame:
    """``routed`` with the leaves of over twice ``leaf`` rows split on while any of them can be.

    A round takes the leaves that the one before made. Each is fitted on about ``sample`` of its classes,
    drawn by hash, so no task gets a leaf; in the join of classes to trees the trees are unique.
    """
    made: DataFrame | None = None
    while True:
        sizes = routed.select(F.explode("leaves").alias("of")).groupBy("of").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * leaf)
        sizes = written(sizes if made is None else sizes.join(made, "of", "left_semi"), "sizes")
        if sizes.isEmpty():
            return routed
        placed = routed.select("node", "vector", F.explode("leaves").alias("leaf"))
        rank = F.shiftrightunsigned(F.xxhash64("node", "leaf"), 1) / float(1 << 63)
        shown = placed.join(sizes, F.col("leaf") == F.col("of")).where(rank * F.col("n") < sample).select("leaf", "n", "vector")

        def fit(group: pd.DataFrame) -> pd.DataFrame:
            of, n = int(group["leaf"].iloc[0]), int(group["n"].iloc[0])
            order = sorted(range(len(group)), key=lambda k: group["vector"].iloc[k].tobytes())  # whatever the order of rows
            tree = grow(unit(np.stack([group["vector"].iloc[k] for k in order])), n / len(group), cosine, leaf, of)
            border, low, high = zip(*tree, strict=True)
            return pd.DataFrame({"of": [of], "border": [list(border)], "low": [list(low)], "high": [list(high)]})

        trees = shown.groupBy("leaf").applyInPandas(fit, "of long, border array<double>, low array<int>, high array<int>")
        trees = written(trees.where(F.size("border") > 1), "trees")

        def down(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                below: list[list[int]] = [[] for _ in range(len(pdf))]
                for of, rows in pdf.groupby("leaf").indices.items():
                    x = unit(np.stack(pdf["vector"].iloc[rows].to_numpy()))
                    tree = list(zip(*(pdf[c].iloc[rows[0]].tolist() for c in ("border", "low", "high")), strict=True))
                    for at, reached in descend(tree, x, _band(cosine, x.shape[1]), int(of)):
                        name = _leaf_name(int(of), at)
                        for r in rows[reached]:
                            below[r].append(name)
                yield pd.DataFrame({"moved": pdf["node"], "old": pdf["leaf"], "below": below})

        moved = placed.join(trees, F.col("leaf") == F.col("of")).select("node", "leaf", "vector", "border", "low", "high")
        moved = written(moved.mapInPandas(down, "moved long, old long, below array<long>"), "moved")
        made = written(moved.select(F.explode("below").alias("of")).distinct(), "made")
        change = moved.groupBy("moved").agg(F.collect_list("old").alias("old"), F.flatten(F.collect_list("below")).alias("below"))
        leaves = F.when(F.col("moved").isNull(), F.col("leaves")).otherwise(F.array_sort(F.array_union(F.array_except("leaves", "old"), "below")))
        routed = written(routed.join(change, F.col("node") == F.col("moved"), "left").select("vector", "node", "copies", leaves.alias("leaves")), "routed")


def _leaf_name(of: int, at: int) -> int:
    """Number of the leaf ``at`` of the tree below leaf ``of``."""
    digest = hashlib.blake2b(struct.pack("<qq", of, at), digest_size=8).digest()
    return struct.unpack("<q", digest)[0]


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(fine & F.exists(vector, lambda v: v != 0), F.lit(False))


def _met_before(leaves: list[np.ndarray], here: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs (a, b) share a leaf that comes before ``here``."""
    used, inverse = np.unique(np.concatenate((a, b)), return_inverse=True)
    lists = [leaves[r][leaves[r] < here] for r in used]
    names, column = np.unique(np.concatenate(lists), return_inverse=True)
    if not len(names):
        return np.zeros(len(a), bool)
    member = np.zeros((len(used), len(names)), bool)
    member[np.repeat(np.arange(len(used)), [len(x) for x in lists]), column] = True
    a, b = inverse[: len(a)], inverse[len(a) :]
    if len(a) > 20 * len(used):
        whole = member.astype(np.float32)
        return (whole @ whole.T)[a, b] > 0
    packed, out = np.packbits(member, axis=1), np.zeros(len(a), bool)
    for at in range(0, len(a), 1 << 16):
        part = slice(at, at + (1 << 16))
        out[part] = (packed[a[part]] & packed[b[part]]).any(axis=1)
    return out


def compare(group: pd.DataFrame, cosine: float) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Links of one tile: ``(node, linked)`` counts, and the spanning forest ``(a, b)``."""
    x = unit(np.stack(group["vector"].to_numpy()))
    node, copies = group["node"].to_numpy(), group["copies"].to_numpy()
    parts, leaves, here = group["part"].to_numpy(), group["leaves"].to_list(), int(group["leaf"].iloc[0])
    cross = bool(group["cross"].iloc[0])
    a, b = [], []
    for at in range(0, len(x), 512):
        i, j = np.nonzero(x[at : at + 512] @ x[at:].T >= cosine)
        fit = i < j
        a.append(i[fit] + at)
        b.append(j[fit] + at)
    a, b = np.concatenate(a), np.concatenate(b)
    if cross:
        fit = parts[a] != parts[b]
        a, b = a[fit], b[fit]
    if len(a):
        fit = ~_met_before(leaves, here, a, b)
        a, b = a[fit], b[fit]
    linked = np.bincount(a, copies[b], len(x)) + np.bincount(b, copies[a], len(x))
    some = np.flatnonzero(linked)
    kept = forest(len(x), a, b, np.zeros(len(a), np.int8))
    return pd.DataFrame({"a": node[some], "linked": linked[some].astype(np.int64)}), pd.DataFrame({"a": node[a[kept]], "b": node[b[kept]]})


def near_vectors(vectors: DataFrame, cosine: float = COSINE, trees: int | None = None, leaf: int = LEAF, sample: int = SAMPLE, leaf_sample: int = LEAF_SAMPLE) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` a row of ``vectors(vec_id, embedding)``; ``trees`` by
    ``trees_for`` the number of classes if it is not given."""
    rows = need(vectors, "vec_id", "embedding")
    fit = usable(F.col("embedding")) & F.col("vec_id").isNotNull()
    classes = rows.where(fit).groupBy(F.col("embedding").alias("vector")).agg(F.min("vec_id").cast("long").alias("node"), F.count_distinct("vec_id").alias("copies"))
    classes = written(classes, "classes")
    total = classes.count()
    trees = trees or trees_for(total, cosine, leaf)
    shown = classes.orderBy(F.xxhash64("node"), "node").limit(sample).select("vector").toPandas()["vector"]
    grown = {}
    for size in sorted({len(v) for v in shown}):
        x = unit(np.stack([v for v in shown if len(v) == size]))
        grown[size] = [grow(x, max(1.0, total / max(1, len(shown))), cosine, leaf, t) for t in range(trees)]
    shared = vectors.sparkSession.sparkContext.broadcast(grown)  # grows with the sample only

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sizes = pdf["vector"].map(len).to_numpy()
            leaves: list[list[int]] = [[] for _ in range(len(pdf))]
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                x, base = unit(np.stack(pdf["vector"].iloc[own].to_numpy())), int(size) << 24
                for t, tree in enumerate(shared.value.get(int(size), [[(0.0, 0, 0)]] * trees)):
                    for at, reached in descend(tree, x, _band(cosine, int(size)), t):
                        for r in own[reached]:
                            leaves[r].append((t << 48) | base | at)
            yield pdf.assign(leaves=[np.sort(np.array(v, np.int64)) for v in leaves])

    kind = classes.schema["vector"].dataType.simpleString()
    routed = written(classes.mapInPandas(route, f"vector {kind}, node long, copies long, leaves array<long>"), "routed")
    if total > len(shown):
        routed = split_on(routed, cosine, leaf, leaf_sample)
    spread = routed.select("node", "copies", "vector", "leaves", F.explode("leaves").alias("leaf"))
    dealt = tiled(spread, "leaf", "node", leaf).repartition("leaf", "tile").sortWithinPartitions("leaf", "tile")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in _with_end(batches):
            if pdf is not None:
                held.append(pdf)
                if sum(map(len, held)) < 2 * leaf:
                    continue
            if not held:
                return
            whole = pd.concat(held, ignore_index=True)
            change = np.flatnonzero((np.diff(whole["leaf"]) != 0) | (np.diff(whole["tile"]) != 0)) + 1
            bounds = [0, *change.tolist()] + ([len(whole)] if pdf is None else [])
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                if hi - lo > 1:
                    counts, links = compare(whole.iloc[lo:hi], cosine)
                    yield pd.concat([counts.assign(b=None), links.assign(linked=None)]).astype({"b": "Int64", "linked": "Int64"})
            held = [whole.iloc[bounds[-1] :]]

    found = written(dealt.mapInPandas(run, "a long, linked long, b long"), "found")
    counts = found.where("linked IS NOT NULL").groupBy("a").agg(F.sum("linked").alias("linked"))
    roots = connected_components(found.where("b IS NOT NULL").select("a", "b"))
    known = classes.join(counts, classes["node"] == counts["a"], "left").select("vector", F.col("node").alias("n"), (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("links"))
    known = written(known.join(roots, known["n"] == roots["node"], "left").select("vector", "links", F.coalesce("root", "n").alias("component")), "known")
    out = rows.withColumn("fit", fit).join(known, F.col("fit") & (rows["embedding"] == known["vector"]), "left")
    component = F.coalesce("component", F.col("vec_id").cast("long"))
    return out.select("vec_id", F.coalesce("links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def _with_end(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame | None]:
    """The batches, then None."""
    yield from batches
    yield None


def op1_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's result over the whole ``embeddings`` table."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP1_SQL = """
WITH RECURSIVE v AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0),
fit AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM fit p JOIN fit q ON p.vec_id <> q.vec_id AND len(p.e) = len(q.e)
          WHERE list_cosine_similarity(p.e, q.e) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM fit UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n.n_links, 0) AS n_links, coalesce(c.component_id, vec_id) AS component_id,
       vec_id = coalesce(c.component_id, vec_id) AS kept
FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""
