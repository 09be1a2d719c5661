"""Exact join of documents by the Jaccard similarity of their word shingles.

Jaccard distance is a metric, and two documents link when it is at most 1 - 0.8. Documents with equal shingle sets are
one node from the start. The join has three levels of regions:

1. Rings. The distance to the empty set orders documents by size; a ring holds sizes from lo to 2 lo, and documents of
   at least 0.8 lo are replicated into the ring above them, since a partner may be there.
2. Projections. A ring cuts the universe of shingles into classes by hash. A node's content in a class is a projection,
   and nodes with equal projections meet in one region; only a digest of it travels. A linked pair of sizes up to b
   differs in at most 2b/9 shingles, so many projections agree. Where sizes are too small for that, nodes meet by the
   prefix of their shingles in hash order, which is exact. A passage that many documents share makes regions, too, so
   the nodes of a region are compared by 256 signs of random projections, set so that linked pairs pass; nodes that
   pass, directly or through others, are a family. Small sizes pass without signs.
3. Families. In a family of more than BLOCK nodes, pivots that lie far apart span Voronoi regions. Every node's distance to
   every pivot is computed; nodes within the radius of a pivot are linked to it, and nodes that hang together through
   pivots form a ball. A node goes to the region of its nearest pivot, and, unless it is in the family's largest
   ball, to every region it may have a partner in: if x and y are within r, y's pivot is at most 2r farther from x than
   x's own. Pairs inside the largest ball need no comparison, so its nodes are in one region only, and a family of
   near copies, which is one ball, is done after one pass. Regions are partitions of their own and are split
   again while they are large. What no pivot can split, because all distances are much alike, is joined in blocks.
   Within a region in memory a few pivots and the triangle inequality sort out pairs, and pairs that already hang together
   are skipped. What remains is compared by exact integers.

Documents as pivots for the whole corpus cannot split it: two random documents share no shingle, every distance is 1 and
all windows overlap. Hence the levels 1 and 2 before the pivots.

Level 2 is exact up to hashing: the number of classes is set so that a pair at the threshold misses all regions with
probability below 1e-10, the order of a 64-bit collision.

Defined results: words are runs of other than ASCII white space, A-Z lower-cased; null and white-space texts have no
shingles and link with nothing, not even each other; repeated rows are copies of each other. Rows with a null id link as
others do and take the smallest id that is not null, or null where there is none. The driver gets nothing but counts of rows.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.batches import pieces
from quarry.operators.components import connected_components
from quarry.operators.joins import join_totals
from quarry.session import materialize

WORDS = 5
SMALL = 40  # sizes up to here meet by prefixes
LEAST_CLASSES, CLASS_SIZE, DIGESTS = 48, 5, 72
BLOCK = 1500  # nodes that are joined in memory
PIVOTS, FAR_PIVOTS, CANDIDATES, SHARE = 4, 16, 64, 4000  # in memory; of a large family, the nodes they are chosen from, members a task takes
LEVELS = 4  # how often a family is split into regions
SKETCH_BITS, SKETCH_MOST = 128, 44  # bits that differ at similarity 0.8: 12.8 on average; more than 44 with probability 1e-13
SIGN_WORDS, SIGN_MOST = 4, 86  # of 256 signs, 38.9 differ at similarity 0.8; more than 86 with probability 1e-13
BROADCAST_ROWS = 200_000
SEGMENT = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for n positions."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, b & (1 << 64) - 1, _U)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def _word_hashes(data: np.ndarray) -> np.ndarray:
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, _U)
    up, down = _power_tables(len(data))
    low = data + ((data >= 65) & (data <= 90)) * np.uint8(32)
    values = (low.astype(_U) + _U(1)) * up[: len(data)]
    values[space] = 0
    return mix(np.add.reduceat(values, starts) * down[starts] + (ends - starts).astype(_U))


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash for each word; long texts are cut at white space."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if len(data) <= SEGMENT:
        return _word_hashes(data)
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + SEGMENT)
        while end < len(data):
            tail = data[end : end + SEGMENT]
            gap = np.flatnonzero((tail == 32) | ((tail >= 9) & (tail <= 13)))
            if len(gap):
                end += int(gap[0])
                break
            end += len(tail)
        out.append(_word_hashes(data[at:end]))
        at = end
    return np.concatenate(out)


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the runs of n words; fewer words make one shingle, none make no shingle."""
    w = word_hashes(text or "")
    if not len(w):
        return w
    k = min(n, len(w))
    h = np.full(len(w) - k + 1, k, _U)
    for i in range(k):
        h = (h ^ w[i : len(w) - k + 1 + i]) * _U(_BASE)
        h ^= h >> _U(29)
    return np.unique(mix(h))


@lru_cache(maxsize=1 << 12)
def rings_of(n: int) -> tuple[tuple[int, int], ...]:
    """(ring number, classes) of the rings that a size belongs to or is replicated into."""
    out, lo, k = [], SMALL + 1, 1
    while 5 * n >= 4 * lo:
        hi = 2 * lo
        if n < hi:
            out.append((k, max(LEAST_CLASSES, hi // CLASS_SIZE)))
        lo, k = hi, k + 1
    return tuple(out)


def digests(s: np.ndarray) -> np.ndarray:
    """The regions of a set: prefixes for small sizes, digests of projections by ring for others."""
    n, out = len(s), []
    if 0 < n <= SMALL:
        out.append(s[: n - (4 * n + 4) // 5 + 1] ^ _U(0x5851F42D4C957F2D))
    for ring, classes in rings_of(n):
        c = ((mix(s + _U(ring)) >> _U(32)) * _U(classes)) >> _U(32)
        few = c < min(classes, DIGESTS)
        c, x = c[few], s[few]
        order = np.argsort(c, kind="stable")
        c, x = c[order], x[order]
        if len(c):
            first = np.flatnonzero(np.diff(c, prepend=c[:1] - _U(1)))
            out.append(mix(np.add.reduceat(mix(x ^ _U(0xD6E8FEB86659FD93)), first) + c[first] * _U(_BASE) + _U(ring << 40)))
    return np.concatenate(out) if out else np.zeros(0, _U)


def sign_sketch(s: np.ndarray) -> bytes:
    """Signs of 64 * SIGN_WORDS random projections of the set: for each bit, whether most of its hashes have it."""
    if not len(s):
        return bytes(8 * SIGN_WORDS)
    out = []
    for k in range(SIGN_WORDS):
        bits = np.unpackbits(mix(s + _U((k + 3) * 0x9E6C63D0876A9A47 & (1 << 64) - 1)).view(np.uint8).reshape(-1, 8), axis=1)
        out.append(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(s)).tobytes())
    return b"".join(out)


# --- exact join within a family ----------------------------------------------------------------------------------


class _Union:
    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x


def sketches(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """SKETCH_BITS one-bit minimum hashes of each set, packed."""
    bits = np.empty((len(starts), SKETCH_BITS), np.uint8)
    for k in range(SKETCH_BITS):
        bits[:, k] = np.minimum.reduceat(mix(flat + _U((k + 1) * 0x632BE59BD9B4E019 & (1 << 64) - 1)), starts) & _U(1)
    return np.packbits(bits, axis=1).view(np.uint64)


def linked(inter: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * inter >= percent * (a + b - inter)


def region_join(sets: list[np.ndarray], sides: np.ndarray | None = None, percent: int = 80, balls: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect all sets which links connect. With sides 0 and 1, links within a side may be left out; sets of
    equal balls are known to hang together."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    if n == 2:
        if balls is not None and balls[0] == balls[1]:
            return []
        inter = np.intersect1d(sets[0], sets[1], assume_unique=True).size
        return [(0, 1)] if linked(np.int64(inter), sizes[0], sizes[1], percent) else []
    flat = np.concatenate(sets)
    starts = np.cumsum(sizes) - sizes
    union, links = _Union(n), []
    roots = np.arange(n)
    if balls is not None:
        _, first, back = np.unique(balls, return_index=True, return_inverse=True)
        roots = first[back]
        union.parent = roots.tolist()
        if (roots == roots[0]).all():
            return []

    def common(p: int, others: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of set p with others."""
        if len(others) * 3 > n:
            at = np.searchsorted(sets[p], flat)
            at[at == len(sets[p])] = 0
            return np.add.reduceat(sets[p][at] == flat, starts, dtype=np.int64)[others]
        part = np.concatenate([sets[o] for o in others])
        at = np.searchsorted(sets[p], part)
        at[at == len(sets[p])] = 0
        return np.add.reduceat(sets[p][at] == part, np.cumsum(sizes[others]) - sizes[others], dtype=np.int64)

    def join(p: int, found: np.ndarray) -> None:
        for o in found.tolist():
            a, b = union.find(p), union.find(o)
            if a != b:
                union.parent[max(a, b)] = min(a, b)
                roots[roots == max(a, b)] = min(a, b)
                links.append((p, o))

    # Pivots, each the farthest from those before; every document's distance to each.
    distances = np.ones((0, n))
    if n > 3 * PIVOTS:
        p = int(np.argmax(sizes))
        for _ in range(PIVOTS):
            everyone = np.arange(n)
            inter = common(p, everyone)
            d = 1 - inter / (sizes[p] + sizes - inter)
            distances = np.vstack([distances, d])
            found = everyone[linked(inter, sizes[p], sizes, percent) & (everyone != p)]
            if sides is not None:
                found = found[sides[found] != sides[p]]
            join(p, found)
            p = int(np.argmax(distances.min(axis=0)))
        order = np.lexsort((distances.min(axis=0), distances.argmin(axis=0)))  # by Voronoi region, the centre first
    else:
        order = np.arange(n)
    bits = sketches(flat, starts) if n > 24 else None
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    reach = 1 - percent / 100 + 1e-9
    for p in order.tolist():
        keep = (place > place[p]) & (roots != roots[p]) & (100 * np.minimum(sizes, sizes[p]) >= percent * np.maximum(sizes, sizes[p]))
        if sides is not None:
            keep &= sides != sides[p]
        if len(distances):
            keep &= (np.abs(distances - distances[:, p : p + 1]) <= reach).all(axis=0)
        if bits is not None:
            keep &= np.bitwise_count(bits ^ bits[p]).sum(axis=1) <= SKETCH_MOST
        others = np.flatnonzero(keep)
        if len(others):
            join(p, others[linked(common(p, others), sizes[p], sizes[others], percent)])
    return links


# --- the tables ---------------------------------------------------------------------------------------------------


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def nodes_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, node, check, digests, sketch, text_hash): node and check are the two halves of the set's hash."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"))

    def run(batches):
        for b in pieces(batches):
            sizes, hashes, regions, signs = [], [], [], []
            for t in b.column(1).to_pylist():
                s = shingles(t, n)
                sizes.append(len(s))
                hashes.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                regions.append(digests(s).tobytes())
                signs.append(sign_sketch(s))
            h = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(regions, pa.binary()), pa.array(signs, pa.binary()), b.column(2)], ["doc_id", "n_shingles", "node", "check", "digests", "sketch", "text_hash"])

    return rows.mapInArrow(run, "doc_id long, n_shingles long, node long, check long, digests binary, sketch binary, text_hash long")


def _regions(nodes: DataFrame, parts: int) -> DataFrame:
    """(region, node) for the regions of two nodes or more; two numbers travel for each, sorted in the region's task."""

    def spread(batches):
        for b in pieces(batches, 2048):
            data = b.column(1).to_pylist()
            counts = [len(d) // 8 for d in data]
            node = np.repeat(np.array(b.column(0).to_pylist(), np.int64), counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(data), np.int64)), pa.array(node)], ["region", "node"])

    def several(batches):
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if not got:
            return
        region, node = (np.concatenate(x) for x in zip(*got, strict=True))
        order = np.lexsort((node, region))
        region, node = region[order], node[order]
        fresh = (np.diff(region, prepend=region[:1] - 1) != 0) | (np.diff(node, prepend=node[:1] - 1) != 0)
        region, node = region[fresh], node[fresh]
        first = np.flatnonzero(np.diff(region, prepend=region[:1] - 1))
        size = np.diff(first, append=len(region))
        keep = np.repeat(size > 1, size)
        yield pa.RecordBatch.from_arrays([pa.array(region[keep]), pa.array(node[keep])], ["region", "node"])

    return nodes.select("node", "digests").mapInArrow(spread, "region long, node long").repartition(parts, "region").mapInArrow(several, "region long, node long")


def _fits(n: np.ndarray, signs: np.ndarray, i, j, percent: int) -> np.ndarray:
    """Whether sizes and signs allow a link between nodes i and j. Of small sets each shingle moves many signs, so sizes decide alone."""
    alike = (np.bitwise_count(signs[i] ^ signs[j]).sum(axis=-1) <= SIGN_MOST) | (np.maximum(n[i], n[j]) <= SMALL)
    return (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])) & alike


def _meetings(nodes: DataFrame, parts: int, percent: int) -> DataFrame:
    """(a, b): edges that connect the nodes of each region that may be linked."""
    regions = materialize(_regions(nodes, parts), "regions")
    signed = regions.join(nodes.select("node", "n_shingles", "sketch"), "node").select("region", "node", "n_shingles", "sketch")

    def meet(batches):
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(), np.frombuffer(b"".join(b.column(3).to_pylist()), _U)) for b in batches if b.num_rows]
        if not got:
            return
        region, node, n, signs = (np.concatenate(x) for x in zip(*got, strict=True))
        signs = signs.reshape(-1, SIGN_WORDS)
        order = np.lexsort((node, region))
        region, node, n, signs = region[order], node[order], n[order], signs[order]
        first = np.flatnonzero(np.diff(region, prepend=region[:1] - 1))
        size = np.diff(first, append=len(region))
        two = first[size == 2]
        two = two[_fits(n, signs, two, two + 1, percent)]
        pairs = [np.stack([node[two], node[two + 1]], axis=1)]
        for at, g in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            roots = np.arange(g)
            some, m, sg, found = node[at : at + g], n[at : at + g], signs[at : at + g], []
            for i in range(g - 1):
                others = i + 1 + np.flatnonzero(roots[i + 1 :] != roots[i])
                if len(others):
                    hit = others[_fits(m, sg, i, others, percent)]
                    _, one = np.unique(roots[hit], return_index=True)
                    for j in hit[one].tolist():
                        found.append((some[i], some[j]))
                        roots[roots == roots[j]] = roots[i]
            if found:
                pairs.append(np.array(found, np.int64))
        pairs = np.unique(np.concatenate(pairs), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return signed.repartition(parts, "region").mapInArrow(meet, "a long, b long")


def links(df: DataFrame, nodes: DataFrame, percent: int = 80, n: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a, b): links between nodes that connect whatever links connect."""
    if percent < 80:
        raise ValueError("regions and sketches are set for similarities of 0.8 or more")
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    distinct = nodes.where("n_shingles > 0").groupBy("node", "check").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n_shingles"), F.first("digests").alias("digests"), F.first("sketch").alias("sketch"))
    meetings = materialize(_meetings(materialize(distinct, "distinct"), 2 * parts, percent).distinct(), "meetings")
    family = materialize(connected_components(meetings), "families")
    def node_numbers(found):
        return np.array([np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)[0] for s in found], np.int64)

    def named(batches):
        for b in pieces(batches):
            yield pa.RecordBatch.from_arrays([pa.array(node_numbers([shingles(t, n) for t in b.column(0).to_pylist()])), b.column(0)], ["node", "text"])

    # The text of one document for each node that has a family.
    owners = nodes.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(family, "node")
    owners = materialize(owners, "owners")
    if owners.count() <= BROADCAST_ROWS:
        owners = F.broadcast(owners)
    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    held = texts.join(owners, "doc_id").select("node", "component", "text")
    # Rows without an id find their node by the hash of their set.
    unnamed = texts.where("doc_id IS NULL").select("text").mapInArrow(named, "node long, text string").dropDuplicates(["node"])
    held = held.unionByName(unnamed.join(owners.where("doc_id IS NULL"), "node").select("node", "component", "text"))

    def sets(batches):
        for b in pieces(batches):
            found = [shingles(t, n) for t in b.column(2).to_pylist()]
            h = node_numbers(found)
            keep = pa.array(h == b.column(0).to_numpy())  # rows with the same id and another text are not the node's
            out = pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([s.tobytes() for s in found], pa.binary())], ["node", "component", "shingles"])
            yield out.filter(keep)

    members = held.mapInArrow(sets, "node long, component long, shingles binary").withColumn("ball", F.col("node"))
    sizes = materialize(family.groupBy("component").agg(F.count("*").alias("n")), "sizes")
    return _family_links(members, sizes, parts, percent)


MEMBER = "node long, component long, shingles binary, ball long"


def _stream(batches, keys: int, size: int = 4096):
    """(key, rows) for the runs of equal keys in sorted batches; `keys` columns come first."""
    key, rows = None, []
    for b in pieces(batches, size):
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if row[:keys] != key:
                if rows:
                    yield key, rows
                key, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield key, rows


def _pair_batch(pairs) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64())], ["a", "b"])


def _small(df: DataFrame) -> DataFrame:
    """With a broadcast hint if it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _joined_in_memory(members: DataFrame, parts: int, percent: int) -> DataFrame:
    """(a, b) within each component of (component, i, j, node, side, ball, shingles); sides count where i <> j."""

    def join(batches):
        for (_, i, j), rows in _stream(batches, 3):
            some = {r[0]: r for r in rows}  # a node may come more than once
            node, side, ball, data = zip(*some.values(), strict=True)
            found = region_join([np.frombuffer(x, _U) for x in data], np.array(side) if i != j else None, percent, np.array(ball)) if len(node) > 1 else []
            yield _pair_batch([(node[a], node[b]) for a, b in found])

    groups = members.select("component", "i", "j", "node", "side", "ball", "shingles").repartition(2 * parts, "component", "i", "j")
    return groups.sortWithinPartitions("component", "i", "j", "node").mapInArrow(join, "a long, b long")


def _family_links(members: DataFrame, sizes: DataFrame, parts: int, percent: int, level: int = 0) -> DataFrame:
    """(a, b): links that connect what links connect within the components of `members` (MEMBER), by Voronoi regions.

    `sizes` is (component, n). Members of equal balls are known to hang together.
    """
    whole = F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side")
    few = members.join(_small(sizes.where(F.col("n") <= BLOCK)), "component", "left_semi")
    links = _joined_in_memory(few.select("*", *whole), parts, percent)
    large = materialize(sizes.where(F.col("n") > BLOCK), "large")
    if not large.count():
        return links
    many = materialize(members.join(_small(large), "component").withColumn("draw", F.xxhash64("node", F.lit(level))), "many")

    def far(batches):
        """Pivots far from each other, the first being the largest set."""
        for (component,), rows in _stream(batches, 1):
            sets = [np.frombuffer(r[1], _U) for r in rows]
            nearest, at, chosen = np.ones(len(sets)), int(np.argmax([len(s) for s in sets])), []
            while len(chosen) < min(FAR_PIVOTS, len(sets)):
                chosen.append(at)
                inter = np.array([np.intersect1d(sets[at], s, assume_unique=True).size for s in sets])
                nearest = np.minimum(nearest, 1 - inter / (len(sets[at]) + np.array([len(s) for s in sets]) - inter))
                nearest[chosen] = -1
                at = int(np.argmax(nearest))
            yield pa.RecordBatch.from_arrays([pa.array([component] * len(chosen), pa.int64()), pa.array(range(len(chosen)), pa.int32()), pa.array([rows[c][0] for c in chosen], pa.int64()), pa.array([rows[c][1] for c in chosen], pa.binary())], ["component", "k", "node", "shingles"])

    drawn = many.where(F.pmod("draw", F.ceil(F.col("n") / CANDIDATES)) == 0).select("component", "node", "shingles")  # some CANDIDATES of each family
    pivots = materialize(drawn.repartition(parts, "component").sortWithinPartitions("component", "node").mapInArrow(far, "component long, k int, node long, shingles binary"), "pivots")
    salts = F.ceil(F.col("n") / SHARE).cast("int")
    dealt = many.select("component", F.pmod(F.shiftright("draw", 20), salts).cast("int").alias("salt"), F.lit(-1).alias("k"), "node", "shingles", "ball")
    everywhere = pivots.join(_small(large), "component").select("component", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), "k", "node", "shingles", F.col("node").alias("ball"))
    dealt = dealt.unionByName(everywhere).repartition(2 * parts, "component", "salt").sortWithinPartitions("component", "salt", F.desc("k"), "node")
    reach = 2 * (1 - percent / 100) + 1e-9

    def place(batches):
        """Each member with its nearest pivot, the regions of its windows, and the pivots it is linked to as a bit mask."""
        for (component, _), rows in _stream(batches, 2):
            centres = sorted((r for r in rows if r[0] >= 0), key=lambda r: r[0])
            own = [r for r in rows if r[0] < 0]
            for at in range(0, len(own), 512):
                some = own[at : at + 512]
                sets = [np.frombuffer(r[2], _U) for r in some]
                size = np.array([len(s) for s in sets], np.int64)
                flat, starts = np.concatenate(sets), np.cumsum(size) - size
                d, mask = np.ones((max(1, len(centres)), len(some))), np.zeros(len(some), np.int64)
                for k, (_, _, data, _) in enumerate(centres):
                    centre = np.frombuffer(data, _U)
                    spot = np.searchsorted(centre, flat)
                    spot[spot == len(centre)] = 0
                    inter = np.add.reduceat(centre[spot] == flat, starts, dtype=np.int64)
                    d[k] = 1 - inter / (size + len(centre) - inter)
                    mask |= linked(inter, size, np.int64(len(centre)), percent).astype(np.int64) << k
                home = d.argmin(axis=0)
                near = d <= d.min(axis=0) + reach
                near[home, np.arange(len(some))] = False
                tied = [[r[1] for k, r in enumerate(centres) if m >> k & 1] for m in mask.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r[1] for r in some], pa.int64()), pa.array([component] * len(some), pa.int64()), pa.array([r[2] for r in some], pa.binary()), pa.array([r[3] for r in some], pa.int64()),
                        pa.array(home.astype(np.int32)), pa.array([np.flatnonzero(near[:, i]).tolist() for i in range(len(some))], pa.list_(pa.int32())), pa.array(mask), pa.array(tied, pa.list_(pa.int64())),
                    ],
                    ["node", "component", "shingles", "ball", "home", "windows", "mask", "tied"],
                )

    placed = materialize(dealt.mapInArrow(place, f"{MEMBER}, home int, windows array<int>, mask long, tied array<long>"), "placed")
    links = links.unionByName(placed.select(F.col("node").alias("a"), F.explode("tied").alias("b")).where("a <> b"))

    def melt(batches):
        """For each family: the ball of each pivot. At most 2^FAR_PIVOTS masks."""
        for b in pieces(batches):
            balls = []
            for masks in b.column(1).to_pylist():
                union = _Union(FAR_PIVOTS)
                for m in masks:
                    bits = [k for k in range(FAR_PIVOTS) if m >> k & 1]
                    for k in bits[1:]:
                        x, y = union.find(bits[0]), union.find(k)
                        union.parent[max(x, y)] = min(x, y)
                balls.append([union.find(k) for k in range(FAR_PIVOTS)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(balls, pa.list_(pa.int32()))], ["component", "melted"])

    masks = placed.where("mask <> 0").groupBy("component").agg(F.collect_set("mask").alias("masks"))
    melted = materialize(masks.mapInArrow(melt, "component long, melted array<int>"), "melted")
    # Members of a ball take its name; others keep the ball that they came with.
    lowest = F.log2(F.col("mask").bitwiseAND(-F.col("mask")).cast("double")).cast("int")
    named_ball = F.when(F.col("mask") != 0, F.xxhash64("component", F.get("melted", lowest), F.lit(level))).otherwise(F.col("ball"))
    balled = placed.drop("tied").join(_small(melted), "component", "left").withColumn("ball", named_ball).drop("melted", "mask")
    tops = balled.groupBy("component", "ball").agg(F.count("*").alias("m")).groupBy("component").agg(F.max_by("ball", F.struct("m", "ball")).alias("top"), F.sum("m").alias("n_before"))
    tops = materialize(tops, "tops")
    known = balled.join(_small(tops), "component")
    others = F.when(F.col("ball") == F.col("top"), F.array().cast("array<int>")).otherwise(F.col("windows"))
    known = materialize(known.select("node", "component", "shingles", "ball", "top", "n_before", F.concat(F.array("home"), others).alias("regions")), "known")
    dealt = known.select("component", "ball", "n_before", F.explode("regions").alias("r"))
    found = dealt.groupBy("component", "r").agg(F.count("*").alias("n"), F.max("n_before").alias("n_before"), (F.min("ball") != F.max("ball")).alias("open"))
    found = materialize(found.where("open").withColumn("region", F.xxhash64("component", "r", F.lit(level))), "open")
    # Where a region is nearly as large as its family, distances don't split the family, and it is joined as a whole.
    too_large = (F.col("n") > BLOCK) & ((F.col("n") > 0.7 * F.col("n_before")) | F.lit(level + 1 >= LEVELS))
    stuck = materialize(found.where(too_large).join(known.select("component", "top").distinct(), "component").select("component", "top").distinct(), "stuck")
    split = materialize(found.join(_small(stuck), "component", "left_anti"), "split")
    members = known.select("node", "component", "shingles", "ball", F.explode("regions").alias("r")).join(_small(split.select("component", "r", "region")), ["component", "r"])
    links = links.unionByName(_family_links(members.select("node", F.col("region").alias("component"), "shingles", "ball"), split.select(F.col("region").alias("component"), "n"), parts, percent, level + 1))
    return links.unionByName(_in_blocks(known.select("node", "component", "shingles", "ball"), stuck, parts, percent))


def _in_blocks(members: DataFrame, regions: DataFrame, parts: int, percent: int) -> DataFrame:
    """(a, b) in regions (component, top) that distances don't split: each block with each block of which one is not in the largest ball."""
    if not regions.count():
        return members.sparkSession.createDataFrame([], "a long, b long")
    own = members.join(_small(regions), "component").withColumn("outside", F.col("ball") != F.col("top"))
    counts = own.groupBy("component").agg(F.ceil(F.count_if("outside") / BLOCK).cast("int").alias("out_blocks"), F.ceil(F.count_if(~F.col("outside")) / BLOCK).cast("int").alias("in_blocks"))
    dealt = own.join(_small(materialize(counts, "blocks")), "component")
    # Blocks 0 to out_blocks - 1 are outside the ball. A block of the ball meets those; one outside meets all.
    block = F.when(F.col("outside"), F.pmod(F.xxhash64("node"), F.greatest("out_blocks", F.lit(1)))).otherwise(F.col("out_blocks") + F.pmod(F.xxhash64("node"), F.greatest("in_blocks", F.lit(1)))).cast("int")
    last = F.when(F.col("outside"), F.col("out_blocks") + F.col("in_blocks")).otherwise(F.col("out_blocks")) - 1
    other = F.explode(F.transform(F.sequence(F.lit(0), last), lambda o: F.struct(F.least(o, F.col("block")).alias("i"), F.greatest(o, F.col("block")).alias("j"))))
    groups = dealt.withColumn("block", block).where(last >= 0).select("*", other.alias("g")).select("component", F.col("g.i").alias("i"), F.col("g.j").alias("j"), F.col("block").alias("side"), "node", "ball", "shingles")
    return _joined_in_memory(groups, parts, percent)


def _roots(df: DataFrame, percent: int, n: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, node, text_hash, ..) of the rows, and (node, root, low, copies) of the nodes that have shingles.

    `low` is the smallest id of the node's rows. Rows of a node are counted before they are joined to anything.
    """
    nodes = materialize(nodes_of(df, id_col, text_col, n), "nodes")
    joined = connected_components(links(df, nodes, percent, n, id_col, text_col))
    counted = nodes.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("low"), F.count("*").alias("copies"))
    return nodes, materialize(counted.join(joined, "node", "left").select("node", F.coalesce("component", "node").alias("root"), "low", "copies"), "roots")


def components(df: DataFrame, percent: int = 80, n: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row; component_id is the smallest id that links reach."""
    nodes, roots = _roots(df, percent, n, id_col, text_col)
    lowest = roots.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("n"))
    of_node = join_totals(roots, lowest, ["root"], roots.count()).select("node", "component_id", F.col("copies").alias("n"))
    some = join_totals(nodes.where("n_shingles > 0").select("doc_id", "n_shingles", "node"), of_node, ["node"], nodes.count()).select("doc_id", "n_shingles", "component_id")
    return some.unionByName(nodes.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def keep_one_of_each(df: DataFrame, percent: int = 80) -> DataFrame:
    """One row of each component: that of the smallest id, of several with that id the one with the lowest hash of its text.

    Rows without shingles link with nothing; of those with equal id and text one stays. A null id comes after all others,
    and is one like any other: near copies go, whether they have an id or not.
    """
    nodes, roots = _roots(df, percent, WORDS, "doc_id", "text")
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "text_hash").alias("k")
    rows = nodes.select("n_shingles", "node", key)
    of_node = rows.where("n_shingles > 0").groupBy("node").agg(F.min("k").alias("k"))
    best = of_node.join(roots.select("node", "root"), "node").groupBy("root").agg(F.min("k").alias("k")).select("k.*")
    kept = best.unionByName(rows.where("n_shingles = 0").select("k.*").distinct())
    number = F.col("doc_id").cast("long")
    keyed = df.select(*(F.col(c).alias(f"_c_{c}") for c in df.columns), number.isNull().alias("none"), F.coalesce(number, F.lit(0)).alias("id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    one = keyed.join(kept, ["none", "id", "text_hash"], "left_semi").dropDuplicates(["none", "id", "text_hash"])
    return one.select(*(F.col(f"_c_{c}").alias(c) for c in df.columns))
