"""N-gram Jaccard self-join with a count-vector R-tree.

A document's set holds the hashes of its distinct word shingles; equal sets are one. Its tokens are hashed into groups, and
the groups' counts are the set's point: as a shared shingle adds one to the same coordinate of both points, the sum of
coordinate minima bounds the overlap from above. Points are bulk-loaded into an R-tree, sort-tiled by size and leading
counts into pages of PAGE, with boxes (greatest counts, sizes from and to) of FAN nodes above them. Two trees, or one with
itself, are descended together: a pair of nodes goes if the sum of the minima of its boxes is less than any of its pairs
needs, or if both hold one component already; surviving pairs of points are verified on the shingles themselves.

A tree over unrelated texts prunes nothing (the greatest counts of 32 random points exceed every need), so the join would
be all pairs. Sets are therefore first dealt into families, by banded minima of hashes: two linked sets agree on a whole
band but for a chance of MISS. Families of up to LEAF sets are one tree each, many in a task. A larger family is cut into
leaves of about LEAF sets by a range-partitioned sort over size and counts, each leaf a tree of its own; representatives of the
leaves' components are cut anew and joined until nothing joins (so a crowd of near copies collapses in a few rounds); then
the boxes of the leaves, and of nodes above them, are descended level by level as tables, and the leaves left in pairs are
joined. No link that could join two components is lost but for MISS.

Null and empty texts have an empty set (n_shingles 0), are linked with nothing and are components of their own; texts
with fewer words than a shingle have their whole sequence as one; a very long text is one long set, whose shingles a task
holds once; copies and repeated rows share a component (ties need no order: a component is named by its least doc_id); a
null doc_id gets its row (and a null component where all of its component are null); an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessel.llm.common import blocks, dealt_join, documents, drop_staged, free_name, mix, shingles, small_enough, staged, string_buffers, text_only, words
from tessel.llm.components import compacted, components

#: Points of a page, nodes under a node, and sets of a leaf that one task joins with itself or another.
PAGE, FAN, LEAF = 16, 8, 256
#: Bytes of shingles at which a leaf of long sets is cut earlier.
LEAF_BYTES = 1 << 22
#: Coordinates of a leaf's box, and leaves or nodes under a node of the levels above.
BOX, SPAN = 256, 64
#: Leaves that a sorted partition is cut into, about.
SORTED = 16
#: Chance that two linked sets agree on no band, and minima of a set at most.
MISS, MINIMA = 1e-10, 200
#: Bands that a task gathers before it passes them on, and those of a part, about.
GATHER, PART = 1 << 19, 1 << 20
#: Rows (text keys) that may be broadcast, about 40 bytes each; beyond it the texts are shuffled.
BROADCAST_ROWS = 500_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def band_shape(percent: int) -> tuple[int, int]:
    """Rows of a band and bands: the longest bands with which a set has MINIMA minima at most and pairs are missed by MISS."""
    share, best = min(percent, 99) / 100, None
    for rows in range(1, MINIMA + 1):
        bands = np.ceil(np.log(MISS) / np.log1p(-(share**rows)))
        if best is None or rows * bands <= MINIMA:
            best = rows, int(bands)
        else:
            break
    return best


def multipliers(percent: int) -> np.ndarray:
    """An odd factor for each minimum: an element's rank in it is its hash times the factor, modulo 2^32."""
    rows, bands = band_shape(percent)
    return (mix(np.arange(1, rows * bands + 1, dtype=np.uint64) * _ODD) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def band_hashes(items: np.ndarray, factors: np.ndarray, rows: int) -> np.ndarray:
    """A hash of each band's minima."""
    low = np.full(len(factors), np.iinfo(np.uint32).max, np.uint32)
    ranked = (mix(items) >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(ranked), 256):
        np.minimum(low, (ranked[i : i + 256, None] * factors).min(0), out=low)
    low = low.reshape(-1, rows).astype(np.uint64)
    out = np.arange(1, len(low) + 1, dtype=np.uint64) * _ODD
    for j in range(rows):
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + low[:, j])
    return out


def set_id(items: np.ndarray) -> int:
    total = mix(items * _ODD).sum(dtype=np.uint64) + np.uint64(len(items))
    return int(mix(np.array([total]))[0].astype(np.int64))


def sets_of(batch: pa.RecordBatch, k: int):
    """Sorted distinct shingles of each text of a batch."""
    raw, off = string_buffers(batch.column("text"))
    for i, j in blocks(off):
        _, _, ids, first = words(raw, off[i : j + 1], True)
        for a, b in zip(first[:-1], first[1:], strict=True):
            yield np.unique(shingles(ids[a:b], k))


def describer(k: int, percent: int):
    factors, rows = multipliers(percent), band_shape(percent)[0]

    def described(batches):
        for batch in batches:
            size, sid, bands = [], [], []
            for items in sets_of(batch, k):
                size.append(len(items))
                sid.append(set_id(items))
                bands.append(band_hashes(items, factors, rows).tobytes() if len(items) else b"")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(size, pa.int64()), pa.array(sid, pa.int64()), pa.array(bands, pa.binary())], ["doc_id", "key", "n", "sid", "bands"])

    return described


def _stars(point: np.ndarray, sid: np.ndarray):
    """Ties of each set to the smallest that has the same band, and where one set of each band stands."""
    order = np.lexsort((sid, point))
    p, s = point[order], sid[order]
    new = np.append(True, p[1:] != p[:-1])
    hub = s[np.flatnonzero(new)][np.cumsum(new) - 1]
    away = s != hub
    return compacted(s[away], hub[away]), order[new]


MET = "part int, bands binary, sids binary, ties binary"


def gatherer(parts: int):
    """Bands of sets by part of the hash space, one set for each band, and ties among those that met here."""

    def flush(bands, sids):
        point = np.concatenate([np.frombuffer(b, np.uint64) for b in bands])
        sid = np.repeat(np.array(sids, np.int64), [len(b) // 8 for b in bands])
        ties, one = _stars(point, sid)
        point, sid = point[one], sid[one]
        slot = (point % np.uint64(parts)).astype(np.int64)
        order = np.argsort(slot, kind="stable")
        cut = np.searchsorted(slot[order], np.arange(parts + 1))
        body = [(i, point[order[a:b]].tobytes(), sid[order[a:b]].tobytes(), b"") for i, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
        if len(ties):
            body.append((int(ties[0, 0] % parts), b"", b"", ties.tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*body, strict=True), (pa.int32(), *[pa.binary()] * 3), strict=True)], [x.split()[0] for x in MET.split(", ")])

    def gathered(batches):
        bands, sids, n = [], [], 0
        for batch in batches:
            for sid, b in zip(batch.column("sid").to_pylist(), batch.column("bands").to_pylist(), strict=True):
                bands.append(b)
                sids.append(sid)
                n += len(b) // 8
                if n >= GATHER:
                    yield flush(bands, sids)
                    bands, sids, n = [], [], 0
        if n:
            yield flush(bands, sids)

    return gathered


def met(table: pa.Table) -> pa.Table:
    """Ties among the bands of one part of the hash space, and those that came with them."""
    point, sid, ties = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros((0, 2), np.int64)]
    for bands, sids, made in zip(*(table.column(c).to_pylist() for c in ("bands", "sids", "ties")), strict=True):
        point.append(np.frombuffer(bands, np.uint64))
        sid.append(np.frombuffer(sids, np.int64))
        ties.append(np.frombuffer(made, np.int64).reshape(-1, 2))
    point, sid = np.concatenate(point), np.concatenate(sid)
    if len(point):
        ties.append(_stars(point, sid)[0])
    both = np.concatenate(ties)
    both = compacted(both[:, 0], both[:, 1])
    return pa.table({"a": pa.array(both[:, 0], pa.int64()), "b": pa.array(both[:, 1], pa.int64())})


def _need(a, b, percent: int):
    """The smallest overlap with which sets of these sizes are linked."""
    return -(-percent * (a + b) // (100 + percent))


def counts(items: np.ndarray, groups: int) -> np.ndarray:
    """A set's point."""
    return np.bincount((items & np.uint64(groups - 1)).astype(np.int64), minlength=groups)


def tiled(size: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Sort-tile order: slices by size, in them slices by the first count, in them order of the second."""
    slices = max(1, round((len(size) / PAGE) ** (1 / 3)))
    tile = lambda order: np.argsort(order, kind="stable") * slices // len(order)
    one = tile(np.argsort(size, kind="stable"))
    two = tile(np.lexsort((points[:, 0], one)))
    return np.lexsort((points[:, 1], two, one))


class Tree:
    """Count-vector R-tree of some sets (sorted distinct shingles) with a component each."""

    def __init__(self, sets: list[np.ndarray], comp: np.ndarray, groups: int):
        size = np.array([len(s) for s in sets])
        points = np.stack([np.minimum(counts(s, groups), 65535) for s in sets]).astype(np.uint16)
        self.order = tiled(size, points)
        self.sets, self.size, self.points, self.comp = sets, size[self.order], points[self.order], comp[self.order]
        # from points up: greatest counts, least and greatest size, least and greatest component, children's first
        self.levels = [(self.points, self.size, self.size, self.comp, self.comp)]
        width = PAGE
        while len(self.levels[-1][1]) > 1:
            high, low_n, high_n, low_c, high_c = self.levels[-1]
            at = np.arange(0, len(low_n), width)
            self.levels.append((np.maximum.reduceat(high, at, axis=0), np.minimum.reduceat(low_n, at), np.maximum.reduceat(high_n, at), np.minimum.reduceat(low_c, at), np.maximum.reduceat(high_c, at)))
            width = FAN


def alive(a, b, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of nodes x of level a and y of level b may hold a link between components, and the bounds' excess."""
    (high_a, low_na, high_na, low_ca, high_ca), (high_b, low_nb, high_nb, low_cb, high_cb) = a, b
    need = _need(low_na[x], low_nb[y], percent)
    fit = (100 * high_na[x] >= percent * low_nb[y]) & (100 * high_nb[y] >= percent * low_na[x])
    fit &= ~((low_ca[x] == high_ca[x]) & (low_cb[y] == high_cb[y]) & (low_ca[x] == low_cb[y]))
    at = np.flatnonzero(fit)
    excess = np.full(len(x), -1, np.int64)
    for i in range(0, len(at), 512):
        part = at[i : i + 512]
        excess[part] = np.minimum(high_a[x[part]], high_b[y[part]]).sum(1, dtype=np.int64) - need[part]
    return excess


def survivors(a: Tree, b: Tree, percent: int) -> np.ndarray:
    """Pairs (i of a, j of b, excess) of points that a descent of both trees leaves; each pair once if they are one."""
    depth = max(len(a.levels), len(b.levels)) - 1
    level = lambda t, d: t.levels[min(d, len(t.levels) - 1)]
    x, y = (v.ravel() for v in np.meshgrid(np.arange(len(level(a, depth)[1])), np.arange(len(level(b, depth)[1])), indexing="ij"))
    while True:
        if a is b:
            ordered = x <= y if depth else x < y
            x, y = x[ordered], y[ordered]
        excess = alive(level(a, depth), level(b, depth), x, y, percent)
        keep = excess >= 0
        x, y, excess = x[keep], y[keep], excess[keep]
        if not depth or not len(x):
            return np.stack((x, y, excess), 1)
        depth -= 1
        x, y = _children(x, y, a, b, depth)


def _children(x, y, a: Tree, b: Tree, depth: int):
    """All pairs of the children of node pairs, one level down (a tree that is not as deep stays at its root)."""

    def span(t: Tree, node):
        if depth + 1 >= len(t.levels):
            return node, node + 1
        width = PAGE if depth == 0 else FAN
        return node * width, np.minimum((node + 1) * width, len(t.levels[depth][1]))

    (lo_x, hi_x), (lo_y, hi_y) = span(a, x), span(b, y)
    wide = hi_y - lo_y
    total = (hi_x - lo_x) * wide
    owner = np.repeat(np.arange(len(x)), total)
    at = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
    return lo_x[owner] + at // wide[owner], lo_y[owner] + at % wide[owner]


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Elements in common of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


class Forest:
    """Components as links are found; nodes are their names."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def top(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.top(x), self.top(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def tree_links(sid: np.ndarray, comp: np.ndarray, sets: list[np.ndarray], percent: int, other=None) -> list[tuple[int, int]]:
    """Verified links (sid, sid) that join two components, among sets or between them and another (sid, comp, sets)."""
    linked = lambda u, v: 100 * (o := overlap(u, v)) >= percent * (len(u) + len(v) - o)
    if other is None and len(sets) == 2:
        return [(int(sid[0]), int(sid[1]))] if comp[0] != comp[1] and linked(*sets) else []
    longest = max(len(s) for s in (*sets, *(other[2] if other else ())))
    groups = 1 << min(11, max(4, int(longest - 1).bit_length()))
    a = Tree(sets, comp, groups)
    b, sid_b, sets_b = (a, sid, sets) if other is None else (Tree(other[2], other[1], groups), other[0], other[2])
    got = survivors(a, b, percent)
    forest, out = Forest(), []
    for x, y, _ in got[np.argsort(-got[:, 2], kind="stable")].tolist():
        i, j = a.order[x], b.order[y]
        if forest.top(int(a.comp[x])) != forest.top(int(b.comp[y])) and linked(sets[i], sets_b[j]):
            forest.join(int(a.comp[x]), int(b.comp[y]))
            out.append((int(sid[i]), int(sid_b[j])))
    return out


def _links(rows) -> pa.RecordBatch:
    got = np.array(rows, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], ["a", "b"])


def family_joiner(percent: int):
    """Links within the small families of a task."""

    def joined(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        family, sid = table.column("family").to_numpy(), table.column("sid").to_numpy()
        bodies = table.column("items").to_pylist()
        order = np.lexsort((sid, family))
        order = order[np.append(True, (np.diff(family[order]) != 0) | (np.diff(sid[order]) != 0))]  # repeated rows bring a set twice
        out = []
        for mine in np.split(order, np.flatnonzero(np.diff(family[order])) + 1):
            if len(mine) > 1:
                out += tree_links(sid[mine], sid[mine], [np.frombuffer(bodies[i], np.uint64) for i in mine], percent)
        return pa.Table.from_batches([_links(out)])

    return joined


ITEMS = "family long, sid long, items binary"


def fetcher(k: int):
    """The shingles of the sets asked for, from texts that may have them."""

    def fetched(batches):
        for batch in batches:
            want, family, bodies, at = batch.column("sid").to_numpy(), batch.column("family"), [], []
            for i, items in enumerate(sets_of(batch, k)):
                if len(items) and set_id(items) == want[i]:
                    bodies.append(items.tobytes())
                    at.append(i)
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([family.take(at), batch.column("sid").take(at), pa.array(bodies, pa.binary())], ["family", "sid", "items"])

    return fetched


LEAVES = "family long, leaf long, node long, sids binary, comps binary, ends binary, items binary, box binary, low long, high long, low_comp long, high_comp long"


def _leaf(family: int, node: int, sids, comps, bodies: list[bytes]) -> tuple:
    sids, comps = np.array(sids, np.int64), np.array(comps, np.int64)
    box = np.max([np.minimum(counts(np.frombuffer(b, np.uint64), BOX), 65535) for b in bodies], axis=0).astype(np.uint16)
    size = [len(b) // 8 for b in bodies]
    return (family, int(sids[0]), node, sids.tobytes(), comps.tobytes(), np.cumsum(size).astype(np.int64).tobytes(), b"".join(bodies), box.tobytes(), min(size), max(size), int(comps.min()), int(comps.max()))


def _leaf_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.binary() if "binary" in c else pa.int64() for c in LEAVES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in LEAVES.split(", ")])


def leaf_packer(leaf: int, span: int):
    def packed(batches):
        return pack_leaves(batches, leaf, span)

    return packed


def pack_leaves(batches, leaf: int, span: int):
    """A sorted partition's sets, cut at families' ends and every `leaf` sets; `span` leaves share a node."""
    held, now, leaves, weight = [], None, 0, 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("family", "sid", "comp", "items")), strict=True):
            if held and (row[0] != now or len(held) == leaf or weight > LEAF_BYTES):
                yield _leaf_batch([_leaf(now, node, *zip(*(h[1:] for h in held), strict=True))])
                held, weight = [], 0
            if not held:
                leaves = 0 if row[0] != now else leaves + 1
                now = row[0]
                node = row[1] if leaves % span == 0 else node  # noqa: F821 (the first leaf of a family sets it)
            held.append(row)
            weight += len(row[3])
    if held:
        yield _leaf_batch([_leaf(now, node, *zip(*(h[1:] for h in held), strict=True))])


def leaf_filler(leaf: int, span: int):
    """The leaves of a group as one leaf, or few."""

    def together(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["place"])
        sids, comps, items = zip(*(_unpacked(r) for r in rows), strict=True)
        sids = np.concatenate(sids)
        cols = (np.full(len(sids), rows[0]["family"], np.int64), sids, np.concatenate(comps), [i.tobytes() for some in items for i in some])
        # a group begins `leaf` sets after the one before it, so it is a little more or less than that
        out = pa.Table.from_batches(pack_leaves([pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["family", "sid", "comp", "items"])], leaf + leaf // 4, span))
        return out.set_column(out.column_names.index("node"), "node", pa.array([rows[0]["group"] // span] * len(out), pa.int64()))

    return together


def filled(leaves: DataFrame, leaf: int, span: int) -> DataFrame:
    """Leaves (with their place in the order), those of many small partitions put together: pairs of leaves are made of
    them, so half-empty ones cost the square of their number, however many partitions the sort has."""
    load = F.greatest(F.octet_length("sids") / (8 * leaf), F.octet_length("items") / LEAF_BYTES)
    thin = leaves.select("family", "place", load.alias("load"))
    made = thin.groupBy("family").agg(F.count("*").alias("n"), F.ceil(F.sum("load")).alias("full")).agg(F.sum("n").alias("n"), F.sum("full").alias("full")).first()
    if (made["n"] or 0) <= 2 * (made["full"] or 0):
        return leaves.drop("place")
    before = Window.partitionBy("family").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    groups = thin.select("family", "place", F.floor(F.coalesce(F.sum("load").over(before), F.lit(0.0))).alias("group"))
    groups = F.broadcast(groups) if small_enough(thin, BROADCAST_ROWS) else groups
    out = staged(leaves.join(groups, ["family", "place"]).groupBy("family", "group").applyInArrow(leaf_filler(leaf, span), LEAVES), "filled-leaves")
    drop_staged(leaves)
    return out


def _unpacked(row: dict, side: str = "") -> tuple:
    ends = np.frombuffer(row[f"ends{side}"], np.int64)
    return np.frombuffer(row[f"sids{side}"], np.int64), np.frombuffer(row[f"comps{side}"], np.int64), np.split(np.frombuffer(row[f"items{side}"], np.uint64), ends[:-1])


def leaf_joiner(percent: int, pairs: bool):
    def joined(batches):
        for batch in batches:
            for i in range(batch.num_rows):  # a leaf, or two, at a time: a batch may hold many
                row = batch.slice(i, 1).to_pylist()[0]
                out = tree_links(*_unpacked(row), percent, _unpacked(row, "_b") if pairs else None)
                if out:
                    yield _links(out)

    return joined


def leafed(points: DataFrame, comps: DataFrame | None, leaf: int, span: int) -> DataFrame:
    """Leaves of the families that are more than one component: a range-partitioned sort by size and leading counts."""
    if comps is None:
        now = points.withColumn("comp", F.col("sid"))
    else:
        now = points.join(comps.withColumnsRenamed({"node": "sid"}), "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    states = now.groupBy("family").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("members")).where("low != high")
    states = staged(states, "open-families")
    total = states.agg(F.sum("members")).first()[0] or 0
    now = now.join(states.select("family"), "family", "left_semi")
    size = F.octet_length("items")
    tile = [F.floor(F.log2(size) * 4), F.ascii(F.substring("items", 1, 1))]  # size in steps of a fifth; then the least shingle
    now = now.repartitionByRange(max(1, total // (SORTED * leaf)), "family", *tile, size, "sid").sortWithinPartitions("family", *tile, size, "sid")
    packed = now.select("family", "sid", "comp", "items").mapInArrow(leaf_packer(leaf, span), LEAVES)
    return filled(staged(packed.withColumn("place", F.monotonically_increasing_id()), "leaves"), leaf, span)


NODES = "family long, node long, parent long, kids binary, boxes binary, lows binary, highs binary, low_comps binary, high_comps binary"


def noded(table: pa.Table) -> pa.Table:
    """The node over some leaves or nodes: its children's boxes, sizes and components."""
    rows = sorted(table.to_pylist(), key=lambda r: r["id"])
    whole = lambda c: np.array([r[c] for r in rows], np.int64).tobytes()
    row = (rows[0]["family"], rows[0]["parent"], 0, whole("id"), b"".join(r["box"] for r in rows), *(whole(c) for c in ("low", "high", "low_comp", "high_comp")))
    return pa.table([pa.array([v], pa.int64() if i < 3 else pa.binary()) for i, v in enumerate(row)], names=[c.split()[0] for c in NODES.split(", ")])


def _level(row: dict, side: str):
    ints = lambda c: np.frombuffer(row[f"{c}{side}"], np.int64)
    return ints("kids"), (np.frombuffer(row[f"boxes{side}"], np.uint16).reshape(-1, BOX), *(ints(c) for c in ("lows", "highs", "low_comps", "high_comps")))


def descender(percent: int):
    """Pairs of children of a pair of nodes that may still hold a link between components."""

    def descended(batches):
        for batch in batches:
            for row in batch.to_pylist():
                (ids_a, a), (ids_b, b) = _level(row, ""), _level(row, "_b")
                x, y = (v.ravel() for v in np.meshgrid(np.arange(len(ids_a)), np.arange(len(ids_b)), indexing="ij"))
                if row["node"] == row["node_b"]:
                    x, y = x[x <= y], y[x <= y]
                keep = alive(a, b, x, y, percent) >= 0
                x, y = x[keep], y[keep]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), row["family"], np.int64)), pa.array(ids_a[x]), pa.array(ids_b[y])], ["family", "x", "y"])

    return descended


def node_boxes(batches):
    """Nodes as children of nodes to come: greatest counts, sizes and components of what is under them."""
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            _, (box, low, high, low_c, high_c) = _level(row, "")
            rows.append((row["family"], row["node"], box.max(0).tobytes(), int(low.min()), int(high.max()), int(low_c.min()), int(high_c.max())))
        cols = zip(*rows, strict=True) if rows else [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i == 2 else pa.int64()) for i, c in enumerate(cols)], ["family", "id", "box", "low", "high", "low_comp", "high_comp"])


def leaf_pairs(leaves: DataFrame, percent: int, span: int) -> DataFrame:
    """(family, x, y): leaves whose boxes may hold a link between components, found from the families' top nodes down."""
    level = leaves.select("family", F.col("leaf").alias("id"), F.col("node").alias("parent"), "box", "low", "high", "low_comp", "high_comp")
    levels = []
    while True:
        levels.append(staged(level.groupBy("family", "parent").applyInArrow(noded, NODES), "nodes"))
        count = levels[-1].groupBy("family").agg(F.count("*").alias("n"))
        if count.where(F.col("n") > span).isEmpty():
            break
        above = levels[-1].mapInArrow(node_boxes, "family long, id long, box binary, low long, high long, low_comp long, high_comp long")
        level = above.join(count, "family").withColumn("parent", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / span))).drop("n")
    top = levels[-1].select("family", F.col("node").alias("x"))
    pairs = top.join(top.withColumnRenamed("x", "y"), "family").where("x <= y")  # of SPAN nodes at most in a family
    for nodes in reversed(levels):
        right = nodes.select("family", F.col("node").alias("y"), *(F.col(c).alias(f"{c}_b") for c in nodes.columns if c != "family"))
        pairs = staged(pairs.join(nodes.withColumn("x", F.col("node")), ["family", "x"]).join(right, ["family", "y"]).mapInArrow(descender(percent), "family long, x long, y long"), "node-pairs")
    return pairs


def large_components(points: DataFrame, percent: int, leaf: int, span: int) -> DataFrame | None:
    """(node, comp) of the sets (family, sid, items) of large families; None if nothing is linked."""
    comps, now, size = None, points.select("sid"), points.count()

    def grown(links: DataFrame) -> DataFrame:
        return staged(components(links if comps is None else links.union(comps), "leaf-components"), "large-components")

    while True:
        leaves = leafed(points.join(now, "sid", "left_semi"), comps, leaf, span)
        found = staged(leaves.mapInArrow(leaf_joiner(percent, False), "a long, b long"), "leaf-links")
        drop_staged(leaves)
        if found.isEmpty():
            break
        comps = grown(found)
        # of each component its least set and one in `span` of the rest go on; crowds of near copies collapse so
        of = now.join(comps.withColumnsRenamed({"node": "sid"}), "sid", "left")
        now = staged(of.where(F.col("comp").isNull() | (F.col("comp") == F.col("sid")) | (F.pmod(F.xxhash64("sid", "comp"), F.lit(span)) == 0)).select("sid"), "leaf-heads")
        before, size = size, now.count()
        if 2 * size > before:  # most are components of their own; the descent below is complete without more rounds
            break
    leaves = leafed(points, comps, leaf, span)
    if not leaves.isEmpty():
        pairs = leaf_pairs(leaves, percent, span)
        right = leaves.select("family", F.col("leaf").alias("y"), *(F.col(c).alias(f"{c}_b") for c in ("sids", "comps", "ends", "items")))
        both = pairs.join(leaves.withColumnRenamed("leaf", "x").select("family", "x", "sids", "comps", "ends", "items"), ["family", "x"]).join(right, ["family", "y"])
        found = staged(both.mapInArrow(leaf_joiner(percent, True), "a long, b long"), "pair-links")
        if not found.isEmpty():
            comps = grown(found)
    drop_staged(leaves)
    return comps


def asked_texts(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """Texts (doc_id, key, text) that are the first of a set, with the set."""
    asked = asked.withColumnsRenamed({"doc_id": "_doc", "key": "_key"})
    asked = F.broadcast(asked) if small_enough(asked, BROADCAST_ROWS) else asked
    return texts.join(asked, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("key") == F.col("_key"))).select("family", "sid", "members", "text")


def linked(docs: DataFrame, k: int, percent: int, leaf: int = LEAF, span: int = SPAN) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, n, sid) of each row, and for each set that repeats or has links (sid, comp, first): the component's
    name and its first row, as (void: no doc_id, doc_id, key)."""
    texts = text_only(docs).withColumn("key", F.xxhash64("text"))
    described = staged(texts.mapInArrow(describer(k, percent), "doc_id long, key long, n long, sid long, bands binary"), "shingle-sets")
    full = described.where("n > 0")
    bands = band_shape(percent)[1] * full.count()
    ties = full.select("sid", "bands").mapInArrow(gatherer(max(8, bands // PART + 1)), MET).groupBy("part").applyInArrow(met, "a long, b long")
    families = staged(components(ties, "families").select(F.col("node").alias("sid"), F.col("comp").alias("family")), "families")
    rows = staged(described.drop("bands"), "sets-of-rows")
    drop_staged(described)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("void"), "doc_id", "key")).alias("first")
    sets = rows.where("n > 0").groupBy("sid").agg(first, F.first("n").alias("n"), F.count("*").alias("rows"))
    size = families.groupBy("family").agg(F.count("*").alias("members"))
    asked = staged(sets.join(families, "sid").join(size, "family").select("sid", "family", "members", "n", F.col("first.doc_id").alias("doc_id"), F.col("first.key").alias("key")), "asked")
    fetched = lambda df: asked_texts(texts, df.drop("n")).mapInArrow(fetcher(k), ITEMS)
    small = asked.where(F.col("members") <= leaf)
    tasks = max(1, (small.agg(F.sum("n")).first()[0] or 0) // PART)
    links = staged(fetched(small).groupBy(F.pmod(F.xxhash64("family"), F.lit(tasks))).applyInArrow(family_joiner(percent), "a long, b long"), "links")
    comps = components(links, "components")
    large = asked.where(F.col("members") > leaf)
    if not large.isEmpty():
        points = staged(fetched(large).dropDuplicates(["sid"]), "points")
        more = large_components(points, percent, leaf, span)
        comps = comps if more is None else comps.union(more)
        drop_staged(points)
    comps = staged(comps, "comps").withColumnRenamed("node", "sid")
    drop_staged(families, asked, links)
    repeated = sets.join(comps, "sid", "left").where("rows > 1 or comp is not null").withColumn("comp", F.coalesce("comp", "sid"))
    heads = repeated.groupBy("comp").agg(F.min("first").alias("first"))
    return rows, staged(repeated.select("sid", "comp").join(heads, "comp"), "set-components")


def _with_component(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows with what sets say of theirs; a set may hold any share of the rows."""
    return rows.join(F.broadcast(sets), "sid", "left") if small_enough(sets, BROADCAST_ROWS) else dealt_join(rows, sets, ["sid"])


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, leaf: int = LEAF, span: int = SPAN) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id that links reach) of each row."""
    named = _with_component(*linked(docs, k, percent, leaf, span))
    return named.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("first").isNotNull() & (F.col("n") > 0), F.col("first.doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, without all but the smallest doc_id of each component.

    Of rows that repeat an id and a text one stays; rows with an empty set all stay.
    """
    rows, sets = linked(docs, k, percent)
    named = _with_component(rows.where("n > 0"), sets).where("first is not null")
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key"))
    id_, key, gone_id, gone_key = (free_name(docs, c) for c in ("row_id", "row_key", "gone_id", "gone_key"))
    losers = staged(named.where(~same).select(F.col("doc_id").alias(gone_id), F.col("key").alias(gone_key)).distinct(), "losers")
    twice = not named.where(same).groupBy("doc_id", "key").count().where("count > 1").isEmpty()
    losers = F.broadcast(losers) if small_enough(losers, BROADCAST_ROWS) else losers
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.withColumn(id_, F.col("doc_id").cast("long")).withColumn(key, F.xxhash64(text))
    left = keyed.join(losers, F.col(id_).eqNullSafe(F.col(gone_id)) & (F.col(key) == F.col(gone_key)), "left_anti")
    if twice:
        solid = text.rlike(r"[^\x20\x09-\x0D]")
        left = left.where(solid).dropDuplicates([id_, key]).union(left.where(~solid))
    return left.drop(id_, key)


def op8_count_rtree(spark, sf_dir):
    return jaccard_components(documents(spark, sf_dir), 3, 90)


_SPACE = "[ \\t\\n\\x0B\\f\\r]+"
OP8_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SPACE}'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) END)) AS items FROM w),
u AS (SELECT items, min(doc_id) AS id, len(items) AS n FROM s WHERE len(items) > 0 GROUP BY items),
e AS (SELECT id, n, unnest(items) AS x FROM u),
links AS (SELECT a.id AS a, b.id AS b FROM e a JOIN e b ON a.x = b.x AND a.id < b.id AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT id, id AS other FROM u UNION SELECT r.id, l.b FROM reach r JOIN both_ways l ON r.other = l.a),
least AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
SELECT s.doc_id, len(s.items) AS n_shingles, coalesce(l.component_id, s.doc_id) AS component_id
FROM s LEFT JOIN u ON s.items = u.items LEFT JOIN least l ON u.id = l.id
"""
