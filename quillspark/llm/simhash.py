"""SimHash near-dedup over a Gray-order hierarchical index.

Fingerprints that differ in at most r of 64 bits agree wholly in m of r + m bit blocks, so each
distinct fingerprint is dealt to a bucket for each choice of m blocks, by their value. With one block that is
r + 1 buckets; from the counted number of fingerprints follows the least m for which buckets stay small,
so that the work grows in proportion to the input. In a bucket the
fingerprints are sorted by Gray rank, in which neighbours share long bit patterns; runs of
``FANOUT`` nodes are factored into an upper node that holds the mask of the bits they all agree in
and those bits. Two nodes are compared by the differences in the bits that both have fixed: more than
r prunes all pairs below; r or fewer even if every free bit differed links all pairs below at once.

Result for odd input: null text counts as empty; a text without words has fingerprint 0 and links
like any other; rows are kept one for one (repeated rows too); a null doc_id keeps its row and gets
the component of its fingerprint (null if no row of that component has an id); an empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import broadcast_small, need, tiled, written
from quillspark.llm.graph import connected_components, forest, local_roots

FANOUT = 8
#: Rows of a bucket beyond which it is dealt to tiles.
BUCKET = 32_768
SEED = 42
_LANES = np.uint64(0x0101010101010101)
_CHUNK = 1 << 16
#: Shingles of which all lanes are counted at once; so many stay in a core's cache.
_BLOCK = 1 << 12


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit hashes have each bit set (bit 0 first)."""
    counts = np.zeros(64, np.int64)
    if len(hashes):
        starts = np.arange(0, len(hashes), 255)  # a byte lane holds no more
        for k in range(8):
            lanes = np.add.reduceat((hashes >> np.uint64(k)) & _LANES, starts)
            counts[k::8] += lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return counts


def shingle_hashes(text: str | None, width: int) -> Iterator[np.ndarray]:
    """Hashes of all shingles of a whole text in chunks; of the whole word sequence if it is shorter."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return
    line, n = b" ".join(words), max(1, len(words) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[min(width, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, _CHUNK):
        pairs = zip(starts[at : min(n, at + _CHUNK)].tolist(), last[at : at + _CHUNK].tolist(), strict=True)
        yield np.fromiter((digest(line[i:j], SEED) for i, j in pairs), np.uint64, min(_CHUNK, n - at))


def _packed(counts: np.ndarray, n: int) -> np.ndarray:
    return np.packbits((2 * counts > n).astype(np.uint8), bitorder="little").view(np.uint64)


def fingerprint(text: str | None, width: int) -> int:
    """Unsigned SimHash of a whole text: bit set if over half the shingle hashes have it set."""
    counts, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text, width):
        counts += bit_counts(hashes)
        n += len(hashes)
    return int(_packed(counts, n)[0])


def lane_counts(lanes: np.ndarray) -> np.ndarray:
    """How many hashes of each row of ``lanes`` have each of the 64 bits set.

    Carry-save addition of whole words: three words of a weight give one of that weight and a carry of
    the next, until fewer than three of a weight are left; only those are unpacked to bits.
    """
    counts, weight = np.zeros((len(lanes), 64), np.int64), 0
    while lanes.shape[1]:
        carries = []
        while (third := lanes.shape[1] // 3) > 0:
            x, y, z = lanes[:, :third], lanes[:, third : 2 * third], lanes[:, 2 * third : 3 * third]
            odd = x ^ y
            carries.append((x & y) | (odd & z))
            lanes = np.concatenate((odd ^ z, lanes[:, 3 * third :]), axis=1)
        bits = np.unpackbits(lanes.view(np.uint8), axis=1, bitorder="little").reshape(len(lanes), -1, 64)
        counts += bits.sum(axis=1, dtype=np.int64) << weight
        lanes, weight = np.concatenate(carries, axis=1) if carries else lanes[:, :0], weight + 1
    return counts


def wide_fingerprint(text: str | None, width: int, parts: int) -> tuple[int, np.ndarray]:
    """Number of distinct shingles, and a SimHash over them of ``parts`` times 64 bits."""
    found = list(shingle_hashes(text, width))
    if not found:
        return 0, np.zeros(parts, np.uint64)
    hashes, counts = np.unique(np.concatenate(found)), np.zeros((parts, 64), np.int64)
    salts = np.array([(k + 1) * 0x9E3779B97F4A7C15 % 2**64 for k in range(1, parts)], np.uint64)
    for at in range(0, len(hashes), _BLOCK):
        own = hashes[None, at : at + _BLOCK]
        x = own + salts[:, None]
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        counts += lane_counts(np.concatenate((own, x ^ (x >> np.uint64(31)))))
    return len(hashes), _packed(counts.ravel(), len(hashes))


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """``(doc_id, fp)`` for each row of ``docs``; fp is the fingerprint as a signed long."""
    rows = need(docs, "doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fps = np.fromiter((fingerprint(t, width) for t in pdf["text"]), np.uint64, len(pdf))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "fp": fps.view(np.int64)})

    return rows.mapInPandas(run, f"doc_id {kind}, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in the Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _levels(bucket: np.ndarray, codes: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """Nodes from the single codes up to one root a bucket: first child, mask, pattern, bucket."""
    out = [(np.arange(len(codes) + 1), np.full(len(codes), ~np.uint64(0)), codes, bucket)]
    while True:
        _, mask, bits, of = out[-1]
        fresh = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        if len(fresh) == len(of):
            return out
        place = np.arange(len(of)) - np.repeat(fresh, np.diff(np.append(fresh, len(of))))
        first = np.flatnonzero(place % FANOUT == 0)
        all_set, any_set = np.bitwise_and.reduceat(bits, first), np.bitwise_or.reduceat(bits, first)
        shared = np.bitwise_and.reduceat(mask, first) & ~(all_set ^ any_set)
        out.append((np.append(first, len(of)), shared, all_set & shared, of[first]))


def _leaves(levels: list[tuple[np.ndarray, ...]], depth: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First code below each node, and the first that is no longer below it."""
    lo, hi = nodes, nodes + 1
    for k in range(depth, 0, -1):
        lo, hi = levels[k][0][lo], levels[k][0][hi]
    return lo, hi


def _spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges [lo, hi): the number of the range and the value, for every value in it."""
    n = hi - lo
    which = np.repeat(np.arange(len(lo)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + lo[which]


def search(
    bucket: np.ndarray, codes: np.ndarray, radius: int, most: int = 1 << 15, fits: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) that connect all codes of a bucket which differ in at most ``radius`` bits.

    ``bucket`` and ``codes`` must be sorted by bucket, then Gray rank. Every such pair is linked
    directly or through the members of a group of which all pairs are that near. Pairs looked at one by
    one are left out where ``fits(i, j)`` is false.
    """
    levels = _levels(bucket, codes)
    top = len(levels) - 1
    roots = np.arange(len(levels[top][1]))
    stack, found = [(top, roots, roots)], []
    while stack:
        depth, a, b = stack.pop()
        if len(a) > most:
            half = len(a) // 2
            stack += [(depth, a[half:], b[half:]), (depth, a[:half], b[:half])]
            continue
        child, mask, bits, _ = levels[depth]
        both = mask[a] & mask[b]
        near = np.bitwise_count((bits[a] ^ bits[b]) & both).astype(np.int16)
        keep = near <= radius
        a, b, near, both = a[keep], b[keep], near[keep], both[keep]
        if depth == 0:
            a, b = a[a != b], b[a != b]
            if fits is not None:
                good = fits(a, b)
                a, b = a[good], b[good]
            found.append((a, b))
            continue
        whole = near + np.bitwise_count(~both) <= radius
        if whole.any():
            (alo, ahi), (blo, bhi) = _leaves(levels, depth, a[whole]), _leaves(levels, depth, b[whole])
            which, x = _spread(alo, ahi)
            found.append((x, blo[which]))
            which, x = _spread(blo, bhi)
            found.append((x, alo[which]))
            a, b = a[~whole], b[~whole]
        which, x = _spread(child[a], child[a + 1])
        inner, y = _spread(child[b[which]], child[b[which] + 1])
        x, own = x[inner], (a == b)[which][inner]
        fit = ~own | (x <= y)
        if fit.any():
            stack.append((depth - 1, x[fit], y[fit]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def choices(n: int, radius: int, bits: int, bucket_rows: int) -> list[tuple[int, ...]]:
    """Masks of the bits that make the bucket keys: codes that differ in at most ``radius`` bits agree under
    one of them, and ``n`` evenly spread codes fill no bucket beyond ``bucket_rows``."""
    for m in range(1, 5):
        edges = np.linspace(0, bits, radius + m + 1).round().astype(int)
        blocks = [((1 << int(hi - lo)) - 1) << int(lo) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
        masks = [sum(of) for of in combinations(blocks, m)]
        if n <= bucket_rows << min(k.bit_count() for k in masks):
            break
    return masks


def _in_tiles(rows: DataFrame, bucket_rows: int, columns: tuple[str, ...], made, schema: str, coarse: str | None = None) -> DataFrame:
    """``made(own, columns)`` over the tiles of ``rows(block, node, ...)``: ``own`` numbers the rows' tiles."""
    dealt = tiled(rows, "block", "node", bucket_rows, coarse).select("block", "tile", *columns)
    dealt = dealt.repartition("block", "tile").sortWithinPartitions("block", "tile")

    def of_tiles(block: np.ndarray, tile: np.ndarray, *rest: np.ndarray) -> pd.DataFrame:
        own = np.cumsum(np.concatenate(([0], ((block[1:] != block[:-1]) | (tile[1:] != tile[:-1])).astype(np.int64))))
        return made(own, *rest)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, ...]] = []
        for pdf in batches:
            held.append(tuple(pdf[c].to_numpy(np.int64) for c in ("block", "tile", *columns)))
            if sum(len(h[0]) for h in held) >= 4 * bucket_rows:
                rows = [np.concatenate(x) for x in zip(*held, strict=True)]
                block, tile = rows[:2]
                other = np.flatnonzero((block != block[-1]) | (tile != tile[-1]))
                if len(other):
                    cut = int(other[-1]) + 1
                    yield of_tiles(*(r[:cut] for r in rows))
                    rows = [r[cut:] for r in rows]
                held = [tuple(rows)]
        if held:
            yield of_tiles(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return dealt.mapInPandas(run, schema)


def near_links(codes: DataFrame, n: int, radius: int = 4, bits: int = 64, bucket_rows: int = BUCKET) -> DataFrame:
    """Links ``(a, b)`` between nodes of ``codes(lane, code, node)``, ``n`` a lane, that connect all codes of
    a lane within ``radius`` of ``bits`` bits.

    Every link is such a pair; a task sends on a cheapest spanning forest of those it finds, so at most
    one link a node and tile, whatever the size of its group. Ties go to the smallest nodes, so that
    the tiles and lanes that see a group mostly choose the same links.
    """

    def links(own: np.ndarray, code: np.ndarray, node: np.ndarray) -> pd.DataFrame:
        code = code.view(np.uint64)
        order = np.lexsort((node, gray_rank(code), own))
        own, code, node = own[order], code[order], node[order]
        fresh = np.append(True, (own[1:] != own[:-1]) | (code[1:] != code[:-1]))
        first = np.flatnonzero(fresh)
        equal = np.flatnonzero(~fresh)  # each to the smallest node of its code
        to = first[np.cumsum(fresh) - 1][equal]
        own, code, least = own[first], code[first], node[first]
        a, b = search(own, code, radius)
        cost = np.bitwise_count(code[a] ^ code[b])
        order = np.lexsort((np.maximum(least[a], least[b]), np.minimum(least[a], least[b]), cost))
        a, b = a[order], b[order]
        kept = forest(len(code), a, b, cost[order])
        return pd.DataFrame({"a": np.concatenate((node[equal], least[a[kept]])), "b": np.concatenate((node[to], least[b[kept]]))})

    signed = lambda k: k - (1 << 64) if k >> 63 else k
    keys = [F.xxhash64(F.lit(k), "lane", F.col("code").bitwiseAND(F.lit(signed(mask)).cast("long"))) for k, mask in enumerate(choices(n, radius, bits, bucket_rows))]
    rows = codes.select("code", "node", F.explode(F.array(*keys)).alias("block"))
    return _in_tiles(rows, bucket_rows, ("code", "node"), links, "a long, b long")


def _parts(checks: np.ndarray, most: int) -> np.ndarray:
    """Number of the connected part of each row, rows being linked that differ in at most ``most`` bits."""
    part, rest, k = np.zeros(len(checks), np.int64), np.arange(len(checks)), 0
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        part[front[0]] = k
        while front and len(rest):
            near = np.bitwise_count((checks[rest] ^ checks[front.pop()]).view(np.uint64)).sum(axis=1) <= most
            part[rest[near]] = k
            front.extend(rest[near])
            rest = rest[~near]
        k += 1
    return part


def near_clusters(codes: DataFrame, radius: int, most: int, bucket_rows: int = BUCKET) -> DataFrame:
    """Clusters ``(cluster, node)`` of two nodes or more of ``codes(block, coarse, node, c1, c2, grp)``: each pair of a
    block within ``radius`` bits in c1 and within ``most`` in c1 and c2 is in one of them, unless both are of
    the same ``grp``. Rows of a block have the same ``coarse``.

    Clusters are whole: nothing is chosen among a cluster's pairs; those of nodes of one group alone, which
    are connected already, are left out. Equal clusters of several blocks have the same number. No cluster is larger than a tile.
    """

    def clusters(own: np.ndarray, node: np.ndarray, c1: np.ndarray, c2: np.ndarray, grp: np.ndarray) -> pd.DataFrame:
        none = np.zeros(0, np.int64)
        shared = np.bincount(own)[own] > 1
        if not shared.any():
            return pd.DataFrame({"cluster": none, "node": none})
        own, node, c1, c2, grp = own[shared], node[shared], c1[shared], c2[shared], grp[shared]
        code = c1.view(np.uint64)
        order = np.lexsort((node, c2, gray_rank(code), own))
        own, code, node, grp, checks = own[order], code[order], node[order], grp[order], np.stack((c1[order], c2[order]), axis=1)
        fresh = np.append(True, (own[1:] != own[:-1]) | (checks[1:] != checks[:-1]).any(axis=1))
        first = np.flatnonzero(fresh)
        x, y = checks[first].T.copy().view(np.uint64)
        a, b = search(own[first], code[first], radius, fits=lambda i, j: np.bitwise_count(x[i] ^ x[j]) + np.bitwise_count(y[i] ^ y[j]) <= most)
        of = local_roots(len(first), a, b)[np.cumsum(fresh) - 1]
        order = np.lexsort((node, of))
        starts = np.flatnonzero(np.append(True, np.diff(of[order]) != 0))
        ends = np.append(starts[1:], len(order))
        names, nodes = [], []
        mixed = np.minimum.reduceat(grp[order], starts) != np.maximum.reduceat(grp[order], starts)
        for lo, hi in zip(starts[mixed].tolist(), ends[mixed].tolist(), strict=True):
            rows = order[lo:hi]
            part = _parts(checks[rows], most)
            for k in range(part.max() + 1):
                inside = rows[part == k]
                members = node[inside]
                if len(members) > 1 and (grp[inside] != grp[inside[0]]).any():
                    nodes.append(members)
                    names.append(np.full(len(members), np.uint64(xxhash.xxh64_intdigest(members.tobytes(), SEED)).view(np.int64)))
        return pd.DataFrame({"cluster": np.concatenate((none, *names)), "node": np.concatenate((none, *nodes))})

    return _in_tiles(codes, bucket_rows, ("node", "c1", "c2", "grp"), clusters, "cluster long, node long", "coarse").distinct()


def simhash_groups(docs: DataFrame, width: int = 4, radius: int = 4, bucket_rows: int = BUCKET) -> DataFrame:
    """``(doc_id, fp, component_id)`` a row of ``docs``: smallest doc_id reachable over links."""
    fps = written(fingerprints(docs, width), "fingerprints")
    classes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "classes")
    codes = classes.select(F.lit(0).alias("lane"), F.col("fp").alias("code"), F.col("fp").alias("node"))
    roots = connected_components(near_links(codes, classes.count(), radius, 64, bucket_rows))
    owned = classes.join(roots, classes["fp"] == roots["node"], "left").select(
        F.col("fp").alias("code"), F.coalesce("root", "fp").alias("root"), "least_id"
    )
    owned = written(owned, "owned")
    least = owned.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = owned.select("code", "root").join(least, "root").select("code", "component_id")
    return fps.join(named, fps["fp"] == named["code"]).select("doc_id", "fp", "component_id")


#: 64-bit parts of the similarity search's fingerprint.
PARTS = 24
#: Rows of a bucket that the keys' width aims at, least width of a key, chance to miss a pair at the threshold.
KEY_ROWS, KEY_BITS, MISSED = 64, 14, 0.002
#: Of the keys, the share that makes the first round.
FIRST = 0.3
#: Bits of 64 that two codes of a bucket may differ in. At 0.8 about 10 differ, with a standard deviation of 2.9.
RADIUS = 20


#: Estimated similarities that are nearer to the threshold than this are verified. At 0.8 the estimate's
#: standard deviation over 1,536 bits is about 0.021, so these are more than four deviations.
MARGIN = 0.09
#: Pairs of which one text has at most so many shingles are compared on their sets, whatever the estimate.
EXACT = 256
#: Texts of at most so many shingles are also found by prefix filtering, as few shingles give poor fingerprints.
SHORT = 32
#: Bits of 128 beyond which two codes that met in a bucket are no candidates: at 0.8 about 20 differ, with a
#: standard deviation of 4.1; of unlike texts 64 do.
CHECKED = 40


def _size_with(n: int, share: float) -> int:
    """Largest set that may have a Jaccard similarity of ``share`` with one of ``n``."""
    return int(n / share + 1e-9)


def prefix(hashes: np.ndarray, share: float) -> np.ndarray:
    """The smallest of the sorted distinct hashes: two sets with a Jaccard similarity of at least ``share``
    have one of them in common."""
    return hashes[: len(hashes) - int(np.ceil(share * len(hashes) - 1e-9)) + 1]


def key_plan(n: int, share: float) -> tuple[int, int]:
    """Width and number of the keys for ``n`` fingerprints.

    The width keeps buckets at about ``KEY_ROWS`` unlike codes whatever ``n`` is, so the pairs looked at grow as the
    rows do. Two sets of a Jaccard similarity of ``share`` differ in a bit with a chance that follows from
    the angle between them; the number of keys is that at which all differ with a chance of ``MISSED``. Keys
    beyond the stretches there are share bits with others, so half as many again are added for these.
    """
    width = max(KEY_BITS, (max(n - 1, 0) // KEY_ROWS).bit_length())
    same = 1 - math.acos(2 * share / (1 + share)) / math.pi
    number = math.ceil(math.log(MISSED) / math.log1p(-(same**width)))
    return width, number + max(0, number - 64 * PARTS // width) // 2


def key_windows(k: int, width: int) -> list[tuple[int, int]]:
    """First bit and number of bits of the pieces of key ``k``: a stretch of the fingerprint that no other key has
    as long as there are such; then half of one stretch with half of another, no two twice."""
    of = 64 * PARTS // width
    lap, at = divmod(k, of)
    half = width // 2
    return [(at * width, half), ((at + lap) % of * width + half, width - half)] if lap else [(at * width, width)]


def _window(start: int, width: int) -> Column:
    word, at = divmod(start, 64)
    low = F.shiftrightunsigned(F.col("bits")[word], at)
    if at + width > 64:
        low = low.bitwiseOR(F.shiftleft(F.col("bits")[word + 1], 64 - at))
    return low.bitwiseAND(F.lit((1 << width) - 1))


def candidates(wide: DataFrame, width: int, numbers: range, bucket_rows: int = BUCKET) -> DataFrame:
    """``(cluster, node)`` of ``wide(node, bits, grp)`` by some of the keys: the pairs of each cluster are
    to be compared, but for those of one ``grp``."""
    keys = []
    for k in numbers:
        low, *high = key_windows(k, width)
        keys.append(_window(*low).bitwiseOR(F.shiftleft(_window(*high[0]), low[1])) if high else _window(*low))
    each = wide.select("node", "grp", "bits", F.posexplode(F.array(*keys)).alias("at", "key"))
    number = F.col("at") + numbers.start
    word = F.floor(number % (64 * PARTS // width) * width / 64).cast("int")
    codes = each.select(
        "node",
        "grp",
        F.xxhash64(number, "key").alias("block"),
        F.xxhash64(number, F.shiftright("key", 6)).alias("coarse"),
        F.get("bits", (word + 8) % PARTS).alias("c1"),
        F.get("bits", (word + 16) % PARTS).alias("c2"),
    )
    return near_clusters(codes, RADIUS, CHECKED, bucket_rows)


def rare_candidates(wide: DataFrame, bucket_rows: int = BUCKET) -> DataFrame:
    """``(cluster, node)`` of ``wide(node, rare)``: those that have one of their rarest shingles in common."""
    rare = written(wide.select("node", F.explode("rare").alias("shingle")), "rare")
    often = rare.groupBy(F.col("shingle").alias("s")).agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    dealt = tiled(rare.join(often, rare["shingle"] == often["s"], "left_semi"), "shingle", "node", bucket_rows)
    return dealt.select(F.xxhash64("shingle", "tile").alias("cluster"), "node")


def compare(node: np.ndarray, n: np.ndarray, bits: np.ndarray, sets: list[np.ndarray | None], grp: np.ndarray, share: float) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of a whole cluster: links ``(a, b)`` that connect all its pairs of a Jaccard similarity of at least
    ``share``, and the pairs that the estimate leaves open and that no link connects.

    Pairs with both sets are compared on them; others by the estimate from the share of differing bits,
    which is the angle between the sets. Only pairs that are not connected yet are looked at; those of
    the same ``grp`` are.
    """
    has = np.array([x is not None for x in sets])
    held = [x if x is not None else np.zeros(0, np.int64) for x in sets]
    ends = np.cumsum([len(x) for x in held])
    known, ids = np.unique(np.concatenate(held), return_inverse=True)
    mark, group = np.zeros(len(known), bool), np.unique(grp, return_inverse=True)[1]
    links, open_ = [], []
    for i in range(len(node) - 1):
        j = np.arange(i + 1, len(node))
        j = j[(group[j] != group[i]) & (np.minimum(n[j], n[i]) >= share * np.maximum(n[j], n[i]) - 1e-9)]
        if not len(j):
            continue
        both = has[j] & has[i]
        like = np.zeros(len(j))
        if both.any():
            own = ids[ends[i] - len(held[i]) : ends[i]]
            mark[own] = True
            sums = np.concatenate(([0], np.cumsum(mark[ids])))
            mark[own] = False
            y = j[both]
            common = sums[ends[y]] - sums[ends[y] - n[y]]
            like[both] = np.where(common >= share * (n[i] + n[y] - common) - 1e-9, 2.0, 0.0)
        if not both.all():
            y = j[~both]
            differ = np.bitwise_count((bits[y] ^ bits[i]).view(np.uint64)).sum(axis=1)
            common = np.cos(differ * (np.pi / (64 * PARTS))) * np.sqrt(n[y].astype(float) * n[i])
            like[~both] = common / (n[y] + n[i] - common)
        sure = j[like >= share + MARGIN]
        unsure = j[(like >= share - MARGIN) & (like < share + MARGIN)]
        if len(sure):
            _, at = np.unique(group[sure], return_index=True)  # one link to each group
            links.append(np.stack((np.full(len(at), i), sure[at]), axis=1))
            group[np.isin(group, group[sure])] = group[i]
        if len(unsure):
            open_.append(np.stack((np.full(len(unsure), i), unsure), axis=1))
    return [node[x] for x in links], [node[x[group[x[:, 0]] != group[x[:, 1]]]] for x in open_]


def shingle_sets(asked: DataFrame, rows: DataFrame, names: DataFrame, width: int) -> DataFrame:
    """``(node, shingles)`` of the nodes of ``asked(v)``. ``names(node, doc_id, text_key)`` has a row of
    ``rows`` for each node."""
    keys = written(names.join(asked, names["node"] == asked["v"], "left_semi").select("node", F.col("doc_id").alias("i"), F.col("text_key").alias("k")), "keys")
    texts = rows.join(broadcast_small(keys), F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text_key") == F.col("k"))).select("node", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for node, text in zip(pdf["node"], pdf["text"], strict=True):
                found = list(shingle_hashes(text, width))
                yield pd.DataFrame({"node": [node], "shingles": [np.unique(np.concatenate(found)).view(np.int64) if found else np.zeros(0, np.int64)]})

    return written(texts.mapInPandas(run, "node long, shingles array<long>").dropDuplicates(["node"]), "sets")


def similar_groups(wide: DataFrame, rows: DataFrame, names: DataFrame, width: int, share: float) -> DataFrame:
    """``(node, root)`` of the nodes of ``wide(node, n, bits, rare)`` that are connected by a Jaccard similarity of at
    least ``share``. All pairs of a cluster are compared before any is left out.

    The first keys find most of every large group; a second round looks by the other keys for what
    the first has not connected, so a large group does not meet again in each of them.
    """
    bits, n = key_plan(wide.count(), share)
    early = math.ceil(FIRST * n)
    found, roots = [], None
    for numbers in (range(early), range(early, n)):
        if roots is None:
            grouped = wide.withColumn("grp", F.col("node"))
            met = candidates(grouped, bits, numbers).union(rare_candidates(wide))
        else:
            own = roots.select(F.col("node").alias("v"), "root")
            grouped = written(wide.join(own, wide["node"] == own["v"], "left").select("node", "n", "bits", F.coalesce("root", "node").alias("grp")), "grouped")
            met = candidates(grouped, bits, numbers)
        found.append(written(similar_links(written(met, "met"), grouped, rows, names, width, share), "similar"))
        links = found[0] if len(found) == 1 else found[0].union(found[1])
        roots = written(connected_components(links), "roots")
    return roots


def similar_links(met: DataFrame, wide: DataFrame, rows: DataFrame, names: DataFrame, width: int, share: float) -> DataFrame:
    """Links ``(a, b)`` that, with the groups ``grp``, connect the nodes of each cluster of ``met(cluster, node)`` that are alike.
    ``wide(node, n, bits, grp)`` has all nodes."""
    asked = met.select(F.col("node").alias("v")).distinct()
    small = wide.where(F.col("n") <= _size_with(EXACT, share)).select(F.col("node").alias("w"))
    sets = shingle_sets(asked.join(small, asked["v"] == small["w"], "left_semi"), rows, names, width)
    sets = sets.select(F.col("node").alias("y"), "shingles")
    full = wide.join(asked, wide["node"] == asked["v"], "left_semi").select(F.col("node").alias("x"), "n", "bits", "grp")
    full = written(full.join(sets, full["x"] == sets["y"], "left").select("x", "n", "bits", "grp", "shingles"), "full")
    gathered = met.join(full, met["node"] == full["x"]).select("cluster", "node", "n", "bits", "grp", "shingles").repartition("cluster").sortWithinPartitions("cluster")

    def links(parts: list[pd.DataFrame]) -> pd.DataFrame:
        pdf = pd.concat(parts).sort_values("n", kind="stable") if len(parts) > 1 else parts[0].sort_values("n", kind="stable")
        bits = np.stack(pdf["bits"].tolist()).astype(np.int64)
        sets = [None if x is None else np.asarray(x, np.int64) for x in pdf["shingles"]]
        sure, open_ = compare(pdf["node"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), bits, sets, pdf["grp"].to_numpy(np.int64), share)
        both = np.concatenate((np.zeros((0, 2), np.int64), *sure, *open_))
        return pd.DataFrame({"a": both.min(axis=1), "b": both.max(axis=1), "sure": np.arange(len(both)) < sum(map(len, sure))})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            cluster = pdf["cluster"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(cluster)) + 1).tolist(), len(pdf)]
            out = []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if held and held[-1]["cluster"].iloc[0] != cluster[lo]:
                    out.append(links(held))
                    held = []
                held.append(pdf.iloc[lo:hi])
            if out:
                yield pd.concat(out)
        if held:
            yield links(held)

    found = written(gathered.mapInPandas(run, "a long, b long, sure boolean").distinct(), "estimated")
    unsure = found.where("NOT sure").select("a", "b")
    sets = shingle_sets(unsure.select(F.col("a").alias("v")).union(unsure.select("b")).distinct(), rows, names, width)
    left = sets.select(F.col("node").alias("x"), F.col("shingles").alias("sx"))
    right = sets.select(F.col("node").alias("y"), F.col("shingles").alias("sy"))
    both = unsure.join(left, unsure["a"] == left["x"]).join(right, unsure["b"] == right["y"])
    counted = both.select("a", "b", F.size(F.array_intersect("sx", "sy")).alias("common"), (F.size("sx") + F.size("sy")).alias("all"))
    exact = counted.where(F.col("common") >= share * (F.col("all") - F.col("common")) - 1e-9).select("a", "b")
    return found.where("sure").select("a", "b").union(exact)


def keep_one(docs: DataFrame, width: int = 5, share: float = 0.8) -> DataFrame:
    """``docs`` with all columns, cut to one row of each group of near copies: that with the smallest
    doc_id (a row with a null doc_id only if all are such), of these that with the smallest text hash,
    of these that whose columns come first as text.

    Near copies are texts whose sets of ``width``-word shingles have a Jaccard similarity of at least
    ``share``, directly or over others: of short texts found and compared on the sets, of long ones
    estimated from the fingerprints, and near the threshold verified on the sets. Texts without words
    are copies of each other.
    """
    rows = need(docs, "doc_id", "text").withColumn("text_key", F.xxhash64("text"))
    kind, most = rows.schema["doc_id"].dataType.simpleString(), _size_with(SHORT, share)

    def rarest(text: str) -> np.ndarray:
        return prefix(np.unique(np.concatenate(list(shingle_hashes(text, width)))), share).view(np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [wide_fingerprint(t, width, PARTS) for t in pdf["text"]]
            rare = [rarest(t) if 0 < m[0] <= most else np.zeros(0, np.int64) for t, m in zip(pdf["text"], made, strict=True)]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text_key": pdf["text_key"], "n": [m[0] for m in made], "bits": [m[1].view(np.int64) for m in made], "rare": rare})

    prints = rows.mapInPandas(run, f"doc_id {kind}, text_key long, n long, bits array<long>, rare array<long>")
    prints = written(prints.withColumn("node", F.xxhash64("bits", "n")), "prints")
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")
    classes = written(prints.groupBy("node").agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("rare").alias("rare"), F.min(rank).alias("best")), "classes")
    names = classes.select("node", "best.doc_id", "best.text_key")
    roots = similar_groups(classes.select("node", "n", "bits", "rare"), rows, names, width, share)
    own = classes.select(F.col("node").alias("v"), "best").join(roots, F.col("v") == F.col("node"), "left")
    chosen = written(own.groupBy(F.coalesce("root", "v").alias("group")).agg(F.min("best").alias("best")).select(F.col("best.doc_id").alias("i"), F.col("best.text_key").alias("k")), "chosen")
    seen = prints.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    again = written(seen.select(F.col("doc_id").alias("i2"), F.col("text_key").alias("k2")), "again")
    repeated = chosen.join(again, F.col("i").eqNullSafe(F.col("i2")) & (F.col("k") == F.col("k2")), "left_semi")
    single = chosen.join(again, F.col("i").eqNullSafe(F.col("i2")) & (F.col("k") == F.col("k2")), "left_anti")
    whole = docs.select(F.struct("*").alias("row"), F.xxhash64("text").alias("key"))
    same = F.col("row.doc_id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k"))
    once = whole.join(written(single, "single"), same, "left_semi").select("row.*")
    # Of rows with the same id and text, that whose other columns come first as text.
    one_of = whole.join(written(repeated, "repeated"), same).groupBy("i", "k").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*")
    return once.unionByName(one_of)


def op10_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's result over the whole ``documents`` table."""
    groups = simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
