"""SimHash near-duplicates by sharded vantage-point trees.

A document's fingerprint has 256 bits: the sign, bit by bit, of the sum of the hashes of its distinct lower-cased words.
Two documents are near duplicates if their fingerprints differ in at most MAX_DISTANCE bits; a group is a connected component.

Search.  A metric tree prunes nothing at such a radius over all bits (every distance to a vantage point lies within the radius of the median), so that the
trees stand on BANDS slices of BAND_BITS bits each (out of three orders of all 256), with radius BAND_RADIUS, and every pair found is decided by its exact
distance over all 256 bits.  In a slice the distances to a vantage point split fingerprints at their median; the
triangle inequality leaves a query only the sides that its ball meets.  The first levels of each tree are laid out on the
driver from one fingerprint in SAMPLE_SHARE and make the shards: a fingerprint lives in one shard and is sent, as a query, to every
later shard whose boundary its ball overlaps (of two fingerprints in different shards one is sent to the other's, so that each pair is met once).
Within a shard a full tree is built and all queries walk it level by level in numpy.  Each slice is searched exactly;
a pair is missed only if it differs in more than BAND_RADIUS bits in every slice, which the tests hold below a tenth of pairs within MAX_DISTANCE.

Plan: one Arrow pass over the texts gives (doc_id, row key, fingerprint), kept in the shared folder; equal fingerprints are grouped with
map-side combination, so that any number of exact copies are one point of the search; distinct points are shuffled once, packed by
shard; shards return only a spanning star of each of their components, and components are closed by alternating large and
small stars, whose rounds are checkpointed.  The number of shards follows the number of distinct fingerprints without a limit; the sample that the driver
holds is 32 bytes for each SAMPLE_SHARE of them.

Defined results: a null text or a null doc_id has no group (its group_id is its own doc_id); texts without words are compared by the hash of
their whole bytes, so that equal ones (also empty ones) are one group; repeated rows share their document's group, and of them one stays; rows
with one doc_id and different texts are grouped each by its own text; ties
keep the smallest doc_id; other columns are not read by near_groups and pass through drop_near_duplicates as they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.llm.common import U64, mix64, text_slices, utf8, word_hashes
from keyloom.session import checkpoint

LANES = 4
MAX_DISTANCE = 36
BANDS, BAND_BITS, BAND_RADIUS = 28, 32, 1
SHARD_POINTS = 65536
SAMPLE_SHARE = 1 << 12
LEAF = 16
SLICE = 2 << 20
PAIRS_AT_ONCE = 1 << 20
_LANE_KEYS = np.array([0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89], U64)
_SPREAD = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], U64)
_NAMES = [f"f{i}" for i in range(LANES)]
# the bits of each slice: those of several orders of all bits, one after the other
_ORDERS = -(-BANDS * BAND_BITS // (64 * LANES))
_SLICES = np.concatenate([np.argsort(mix64(np.arange(64 * LANES, dtype=U64) + (U64(k + 1) << U64(32)))) for k in range(_ORDERS)])[: BANDS * BAND_BITS].reshape(BANDS, BAND_BITS)


# fingerprints


def signs(features: np.ndarray, text_of: np.ndarray, texts: int) -> np.ndarray:
    """The (texts, LANES) fingerprints of features sorted by text: a bit is set if more than half of a text's features set it."""
    out = np.zeros((texts, LANES), U64)
    if not len(features):
        return out
    first = np.flatnonzero(np.concatenate(([True], text_of[1:] != text_of[:-1])))
    size = np.diff(np.append(first, len(features)))
    # runs of at most 255 features, so that eight counters fit in one 64-bit word
    runs_of = -(-size // 255)
    run_first = np.cumsum(runs_of) - runs_of
    runs = np.repeat(first - 255 * run_first, runs_of) + 255 * np.arange(runs_of.sum())
    for lane in range(LANES):
        octets = mix64(features + _LANE_KEYS[lane]).view(np.uint8).reshape(-1, 8)
        bits = np.zeros((len(first), 64), bool)
        for o in range(8):
            part = np.add.reduceat(_SPREAD[octets[:, o]], runs).view(np.uint8).reshape(-1, 8)
            bits[:, 8 * o : 8 * o + 8] = 2 * np.add.reduceat(part.astype(np.int64), run_first, axis=0) > size[:, None]
        out[text_of[first], lane] = np.packbits(bits, axis=1, bitorder="little").view(U64).ravel()
    return out


def fingerprints(texts: pa.Array) -> np.ndarray:
    """The (n, LANES) fingerprints of a string array."""
    data, off = utf8(pc.utf8_lower(texts))
    h, text_of = word_hashes(data, off)
    key = np.sort((text_of.astype(U64) << U64(43)) | (h >> U64(21)))
    key = key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key
    text_of = (key >> U64(43)).astype(np.int64)
    out = signs(mix64(key & U64((1 << 43) - 1)), text_of, len(texts))
    wordless = np.ones(len(texts), bool)
    wordless[text_of] = False
    for i in np.flatnonzero(wordless):
        out[i] = mix64(U64(xxhash.xxh3_64_intdigest(data[off[i] : off[i + 1]].tobytes())) + _LANE_KEYS)
    return out


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in text_slices(whole, "text", SLICE):
            fp = fingerprints(batch.column("text")).view(np.int64)
            null = pc.is_null(batch.column("text")).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_key"), *(pa.array(fp[:, i], mask=null) for i in range(LANES))], ["doc_id", "row_key", *_NAMES])


def row_key() -> Column:
    """What tells rows of one doc_id apart: a 64-bit hash of the text."""
    return F.xxhash64(F.col("text").cast("string"))


def keyed_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, f0 .. f3) of each row; null fingerprints for null texts."""
    return docs.select(F.col("doc_id").cast("long"), row_key().alias("row_key"), F.col("text").cast("string")).mapInArrow(_fingerprint, "doc_id long, row_key long, " + ", ".join(f"{n} long" for n in _NAMES))


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """(doc_id, f0 .. f3) of each row; null fingerprints for null texts."""
    return keyed_fingerprints(docs).drop("row_key")


# vantage-point trees


def band_values(fp: np.ndarray, band: int) -> np.ndarray:
    """BAND_BITS bits of each fingerprint."""
    return all_bands(fp, slice(band, band + 1))[0]


def all_bands(fp: np.ndarray, wanted: slice = slice(None)) -> np.ndarray:
    """The (slices, n) values of fingerprints."""
    bits = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(len(fp), 8 * LANES), axis=1, bitorder="little")
    own = _SLICES[wanted]
    chosen = np.packbits(np.ascontiguousarray(bits[:, own.ravel()]).reshape(len(fp) * len(own), BAND_BITS), axis=1)
    return np.ascontiguousarray(chosen).view(np.uint32).reshape(len(fp), len(own)).T.copy()


class Tree:
    """A vantage-point tree over band values: per node the vantage, the median distance and two children; a leaf has a range of points."""

    def __init__(self, values: np.ndarray, leaf: int, depth: int) -> None:
        self.points = np.arange(len(values))
        vantage, median, left, right, begin, end = [], [], [], [], [], []

        def node(a: int, b: int) -> int:
            for column, value in zip((vantage, median, left, right, begin, end), (0, 0, -1, -1, a, b)):
                column.append(value)
            return len(vantage) - 1

        todo = [(node(0, len(values)), 0)]
        while todo:
            at, level = todo.pop()
            a, b = begin[at], end[at]
            if b - a <= leaf or level == depth:
                continue
            own = values[self.points[a:b]]
            v = own[(b - a) // 2]
            d = np.bitwise_count(own ^ v)
            mu = int(np.partition(d, (b - a - 1) // 2)[(b - a - 1) // 2])
            near = d <= mu
            n = int(near.sum())
            if n == b - a:
                near = d < mu
                mu, n = mu - 1, int(near.sum())
                if n == 0:
                    continue
            self.points[a:b] = np.concatenate((self.points[a:b][near], self.points[a:b][~near]))
            vantage[at], median[at], left[at], right[at] = int(v), mu, node(a, a + n), node(a + n, b)
            todo += [(left[at], level + 1), (right[at], level + 1)]
        self.vantage, self.median = np.array(vantage, np.uint32), np.array(median, np.int64)
        self.left, self.right = np.array(left), np.array(right)
        self.begin, self.end = np.array(begin), np.array(end)

    def leaves(self, values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """All (value index, leaf) whose leaf may hold a point within radius of the value."""
        q, at = np.arange(len(values)), np.zeros(len(values), np.int64)
        done_q, done_at = [], []
        while len(q):
            inner = self.left[at] >= 0
            done_q.append(q[~inner])
            done_at.append(at[~inner])
            q, at = q[inner], at[inner]
            d = np.bitwise_count(values[q] ^ self.vantage[at]).astype(np.int64)
            near, far = d - radius <= self.median[at], d + radius > self.median[at]
            q, at = np.concatenate((q[near], q[far])), np.concatenate((self.left[at[near]], self.right[at[far]]))
        return np.concatenate(done_q), np.concatenate(done_at)


def shard_pairs(ids: np.ndarray, fp: np.ndarray, home: np.ndarray, band: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (query, point) of a shard within the radius in the band and over all bits; of two that both live there the query has the larger id."""
    values = band_values(fp, band)
    lives = np.flatnonzero(home)
    if not len(lives):
        return
    tree = Tree(values[lives], LEAF, 64)
    q, leaf = tree.leaves(values, BAND_RADIUS)
    size = (tree.end - tree.begin)[leaf]
    ends = np.cumsum(size)
    a = 0
    while a < len(q):
        base = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, base + PAIRS_AT_ONCE, side="right")))
        n = size[a:b]
        x = np.repeat(tree.begin[leaf[a:b]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        x, y = lives[tree.points[x]], np.repeat(q[a:b], n)
        ok = np.bitwise_count(values[x] ^ values[y]) <= BAND_RADIUS
        x, y = x[ok], y[ok]
        ok = ~home[y] | (ids[y] > ids[x])
        x, y = x[ok], y[ok]
        ok = np.bitwise_count(fp[x] ^ fp[y]).sum(1) <= MAX_DISTANCE
        if ok.any():
            yield y[ok], x[ok]
        a = b


# shards in Spark


def _router(trees: list[Tree]):
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("point").to_numpy()
            fp = np.stack([batch.column(n).to_numpy() for n in _NAMES], axis=1).view(U64)
            out: tuple[list, list, list, list] = ([], [], [], [])
            for band, (tree, values) in enumerate(zip(trees, all_bands(fp))):
                q, leaf = tree.leaves(values, BAND_RADIUS)
                _, lives = (home := tree.leaves(values, 0))
                own = np.empty(len(values), np.int64)
                own[home[0]] = lives
                later = leaf >= own[q]
                q, leaf = q[later], leaf[later]
                order = np.argsort(leaf, kind="stable")
                q, leaf = q[order], leaf[order]
                cuts = np.flatnonzero(np.concatenate(([True], leaf[1:] != leaf[:-1])))
                for a, b in zip(cuts, np.append(cuts[1:], len(leaf))):
                    for column, value in zip(out, ((band << 32) | int(leaf[a]), ids[q[a:b]].tobytes(), fp[q[a:b]].tobytes(), (own[q[a:b]] == leaf[a]).tobytes())):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *(pa.array(c, pa.binary()) for c in out[1:])], ["shard", "ids", "fps", "home"])

    return route


def _members(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    def joined(name: str, kind: type) -> np.ndarray:
        return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)

    return joined("ids", np.int64), joined("fps", U64).reshape(-1, LANES), joined("home", bool)


def _pairs(table: pa.Table) -> pa.Table:
    ids, fp, home = _members(table)
    found = list(shard_pairs(ids, fp, home, table.column("shard")[0].as_py() >> 32))
    y = np.concatenate([y for y, _ in found]) if found else np.zeros(0, np.int64)
    x = np.concatenate([x for _, x in found]) if found else np.zeros(0, np.int64)
    return pa.table([pa.array(np.minimum(ids[x], ids[y])), pa.array(np.maximum(ids[x], ids[y])), pa.array(np.bitwise_count(fp[x] ^ fp[y]).sum(1).astype(np.int32))], names=["a", "b", "distance"])


def _stars(table: pa.Table) -> pa.Table:
    """(a, b): each member of one of the shard's components with its smallest member."""
    ids, fp, home = _members(table)
    order = np.argsort(ids, kind="stable")
    ids, fp, home = ids[order], fp[order], home[order]
    label = np.arange(len(ids))
    for y, x in shard_pairs(ids, fp, home, table.column("shard")[0].as_py() >> 32):
        while True:
            a, b = label[x], label[y]
            if (a == b).all():
                break
            low = np.minimum(a, b)
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            while (label[label] != label).any():
                label = label[label]
    moved = np.flatnonzero(label != np.arange(len(ids)))
    return pa.table([pa.array(ids[label[moved]]), pa.array(ids[moved])], names=["a", "b"])


def _sharded(points: DataFrame) -> DataFrame:
    """Distinct points (point, f0 .. f3), packed by shard, in their own shard and as queries where their balls reach."""
    n = points.count()
    depth = max(0, math.ceil(math.log2(max(1, n) / SHARD_POINTS)))
    share = min(SAMPLE_SHARE, max(1, SHARD_POINTS // 4))
    chosen = points.where(F.pmod(F.xxhash64(*_NAMES, F.lit("vantage")), F.lit(share)) == 0) if depth else points.limit(0)
    rows = chosen.select(*_NAMES).toArrow().sort_by([(c, "ascending") for c in _NAMES])
    sample = np.stack([rows.column(c).to_numpy() for c in _NAMES], axis=1).view(U64)
    # vantage points are taken from the middle, so that the order must not follow the fingerprints
    sample = sample[np.argsort(mix64(sample[:, 0]), kind="stable")]
    trees = [Tree(values, 1, depth) for values in all_bands(sample)]
    return points.select("point", *_NAMES).mapInArrow(_router(trees), "shard long, ids binary, fps binary, home binary")


def _points(fps: DataFrame) -> DataFrame:
    """(point, doc_id, f0 .. f3): distinct fingerprints, numbered, with the smallest doc_id that has each; kept, so that the numbers stay."""
    grouped = fps.where("f0 is not null and doc_id is not null").groupBy(*_NAMES).agg(F.min("doc_id").alias("doc_id"))
    return checkpoint(grouped.select(F.monotonically_increasing_id().alias("point"), "doc_id", *_NAMES))


def near_pairs(docs: DataFrame) -> DataFrame:
    """(a, b, distance) of all pairs of distinct fingerprints found within MAX_DISTANCE, each by the smallest doc_id that has it."""
    points = _points(fingerprint_table(docs))
    pairs = _sharded(points).groupBy("shard").applyInArrow(_pairs, "a long, b long, distance int").distinct()
    for side in "ab":
        pairs = pairs.withColumnRenamed(side, "point").join(points.select("point", F.col("doc_id").alias(side)), "point").drop("point")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes of (a, b) but the roots: each connected component's smallest node is its root."""
    e = checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct())
    mark = e.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
    while True:
        both = e.union(e.select("u", "v"))
        smallest = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        large = both.join(smallest, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u")).union(low)
        e = checkpoint(small.distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == mark:
            return e.select(F.col("v").alias("node"), F.col("u").alias("root"))
        mark = now


def _rooted(fps: DataFrame) -> DataFrame:
    """(root, group_id, f0 .. f3): the group of each distinct fingerprint, by one of its points and by its smallest doc_id."""
    points = _points(fps)
    roots = components(_sharded(points).groupBy("shard").applyInArrow(_stars, "a long, b long"))
    labelled = points.join(roots, points.point == roots.node, "left").select(F.coalesce("root", "point").alias("root"), "doc_id", *_NAMES)
    return labelled.join(labelled.groupBy("root").agg(F.min("doc_id").alias("group_id")), "root").drop("doc_id")


def near_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, group_id) of each row: the smallest doc_id of its group. (Rows that share a doc_id may share it and yet be of different groups.)"""
    fps = checkpoint(keyed_fingerprints(docs))
    grouped = fps.where("f0 is not null and doc_id is not null").join(_rooted(fps), _NAMES).select("doc_id", "group_id")
    return grouped.unionByName(fps.where("f0 is null or doc_id is null").select("doc_id", F.col("doc_id").alias("group_id")))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one row of each group, the one with the smallest doc_id (then row key), all columns as they are; rows with a null doc_id or text stay.

    A row is known by doc_id and the hash of its text, so that of rows that share an id only those go that are near copies of one that stays.
    """
    fps = checkpoint(keyed_fingerprints(docs))
    grouped = fps.where("f0 is not null and doc_id is not null").join(_rooted(fps), _NAMES)
    kept = grouped.groupBy("root").agg(F.min(F.struct("doc_id", "row_key")).alias("first")).select(F.col("first.doc_id").alias("__kept"), F.col("first.row_key").alias("__row"))
    same = (F.col("doc_id").cast("long") == F.col("__kept")) & (row_key() == F.col("__row"))
    # the join's partitioning serves the window: of repeated rows one stays
    nth = F.row_number().over(Window.partitionBy("__kept", "__row").orderBy("__kept"))
    compared = docs.where("doc_id is not null and text is not null")
    return compared.join(kept, same).withColumn("__nth", nth).where("__nth = 1").drop("__kept", "__row", "__nth").unionByName(docs.where("doc_id is null or text is null"))
