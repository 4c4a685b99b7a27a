"""Neighbours by hash or vector, and what is built on them."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterlake.functions.batches import ragged
from shutterlake.functions.vectors import hamming, hash_similarity, hex_bits
from shutterlake.operators.rollups import numbered
from shutterlake.sources.shared import kept


#: Rows of a user are compared in tiles of two blocks of about so many rows each.
BLOCK = 2_048
#: Bands of at least so many bits are worth an equi-join: shorter ones make more joined rows than tiles make comparisons.
BAND_BITS = 12
#: Blocks of hashes, which are short: what is shuffled grows with a user's rows by the number of their blocks, 1 to each so many rows.
#: Where hashes are looked up, a tile takes some 15 s; where they are all compared, 3 s.
HASHES, COMPARED = 1 << 20, 1 << 15
#: First bits of the bands by which hashes are looked up, and 64.
EDGES = [0, 21, 42, 64]
#: Comparisons or found rows that are held at once, and how many comparisons take no longer than looking up some hashes.
CELLS, FEW = 1 << 22, 1 << 25


def tiles(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """``rows`` (user_id, id, ...) with (i, j, own): each pair of a user's rows is in just one tile (user_id, i, j), each tile in
    one task. A user with many rows has many tiles; own is the block of the row."""
    counts = rows.groupBy("user_id").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = rows.join(counts, "user_id").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    spread = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return spread.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("blocks", "other")


def _sides(tile: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the tile's two blocks; the same rows twice if it has one."""
    own = tile.column("own").to_numpy()
    i, j = tile.column("i")[0].as_py(), tile.column("j")[0].as_py()
    return np.flatnonzero(own == i), np.flatnonzero(own == j)


def hamming_pairs(rows: DataFrame, distance: int) -> DataFrame:
    """(user_id, a, b, d), a < b, of hashes (user_id, id, h) at most ``distance`` apart.

    Where the 64 bits make distance + 1 bands of BAND_BITS or more, such hashes agree on one, and a pair comes from the first
    band that it agrees on. Where bands would be too short to tell rows apart, tiles are searched.
    """
    if 64 // (distance + 1) < BAND_BITS:
        return _near_in_tiles(rows, distance)
    edges = [round(k * 64 / (distance + 1)) for k in range(distance + 2)]
    band = lambda h, k: F.shiftrightunsigned(h, edges[k]).bitwiseAND(F.lit((1 << (edges[k + 1] - edges[k])) - 1))
    bands = F.array(*(F.struct(F.lit(k).alias("k"), band(F.col("h"), k).alias("v")) for k in range(distance + 1)))
    cut = rows.select("user_id", "id", "h", F.explode(bands).alias("band"))
    a, b = (cut.select("user_id", "band", F.col("id").alias(x), F.col("h").alias("h" + x)) for x in "ab")
    near = a.join(b, ["user_id", "band"]).where("a < b").withColumn("d", hamming(F.col("ha"), F.col("hb"))).where(F.col("d") <= distance)
    first = F.coalesce(*(F.when(band(F.col("ha"), k) == band(F.col("hb"), k), k) for k in range(distance + 1)))
    return near.where(F.col("band.k") == first).select("user_id", "a", "b", "d")


def _probes(distance: int) -> int:
    """How many values of each band a hash at most ``distance`` away can have there, in the band where it is nearest."""
    return sum(comb(EDGES[-1] - EDGES[-2], r) for r in range(distance // (len(EDGES) - 1) + 1))


def _looked_up(distance: int) -> bool:
    """Whether looking up all of these values is less work than comparing all rows of a block."""
    return 64 * _probes(distance) < 1 << EDGES[1]


def _compared(left: np.ndarray, right: np.ndarray | None, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    other = left if right is None else right
    step = max(1, CELLS // max(len(other), 1))
    for k in range(0, len(left), step):
        x, y = np.nonzero(np.bitwise_count(left[k : k + step, None] ^ other[None, :]) <= distance)
        x += k
        yield (x[x < y], y[x < y]) if right is None else (x, y)


def near_hashes(left: np.ndarray, right: np.ndarray | None, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices (x, y), a part at a time, of all hashes left[x] and right[y] (uint64) at most ``distance`` bits apart, each pair once; without
    ``right`` of all such pairs in left.

    Of three bands such hashes have one in which a third of the bits differ at the most (multi-index hashing, Norouzi et al., 2012). For
    each set of so many bits, a band's values meet the values that differ in just these; a pair comes from the first band where it can.
    """
    if len(left) * len(left if right is None else right) <= FEW or not _looked_up(distance):
        yield from _compared(left, right, distance)
        return
    most = distance // (len(EDGES) - 1)
    band = lambda h, k: h >> np.uint64(EDGES[k]) & np.uint64((1 << (EDGES[k + 1] - EDGES[k])) - 1)

    def sorted_by(h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        v = band(h, k).astype(np.int32)
        order = np.argsort(v, kind="stable")
        return order, h[order], np.append(0, np.cumsum(np.bincount(v, minlength=1 << (EDGES[k + 1] - EDGES[k])))).astype(np.int32)

    for k in range(len(EDGES) - 1):
        order_l, sorted_l, first_l = sorted_by(left, k)
        order_r, sorted_r, first_r = (order_l, sorted_l, first_l) if right is None else sorted_by(right, k)
        values = np.flatnonzero(np.diff(first_l)).astype(np.int32)
        for flips in (c for n in range(most + 1) for c in combinations(range(EDGES[k + 1] - EDGES[k]), n)):
            # without right, of two values that meet the one without the last of these bits is looked at
            own = values if right is not None or not flips else values[values & 1 << flips[-1] == 0]
            other = own ^ sum(1 << b for b in flips)
            at = first_r[other]
            n = first_r[other + 1] - at
            hit = np.flatnonzero(n)
            own, n, at = own[hit], n[hit], at[hit]
            # the rows that have these values, and what each meets
            first = first_l[own]
            rows = first_l[own + 1] - first
            x, n, at = ragged(first, rows), np.repeat(n, rows), np.repeat(at, rows)
            ends = np.cumsum(n)
            cuts = [0, *np.searchsorted(ends, np.arange(CELLS, ends[-1], CELLS)).tolist(), len(n)] if len(n) else [0]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                a, b = np.repeat(x[i:j], n[i:j]), ragged(at[i:j], n[i:j])
                near = np.flatnonzero(np.bitwise_count(sorted_l[a] ^ sorted_r[b]) <= distance)
                a, b = a[near], b[near]
                apart, new = sorted_l[a] ^ sorted_r[b], (a < b) | (right is not None or bool(flips))
                for before in range(k):
                    new &= np.bitwise_count(band(apart, before)) > most
                yield order_l[a[new]], order_r[b[new]]


def _hash_tiles(rows: DataFrame, distance: int, *more: str) -> DataFrame:
    return tiles(rows.where("h IS NOT NULL").select("user_id", "id", "h", *more), HASHES if _looked_up(distance) else COMPARED)


def _near_in_tile(tile: pa.Table, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (x, y) of the tile that are near, each two once and none with itself."""
    h = tile.column("h").to_numpy().view(np.uint64)
    left, right = _sides(tile)
    one = tile.column("i")[0] == tile.column("j")[0]
    for x, y in near_hashes(h[left], None if one else h[right], distance):
        yield left[x], right[y]


def _near_in_tiles(rows: DataFrame, distance: int) -> DataFrame:
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = pa.Table.from_batches(batches)
        user, ids, h = tile.column("user_id")[0].as_py(), tile.column("id").to_numpy(), tile.column("h").to_numpy().view(np.uint64)
        for x, y in _near_in_tile(tile, distance):
            new = ids[x] != ids[y]
            x, y = x[new], y[new]
            if len(x):
                d = np.bitwise_count(h[x] ^ h[y]).astype(np.int32)
                yield pa.RecordBatch.from_pydict({"user_id": pa.array(np.full(len(x), user, np.int64)), "a": pa.array(np.minimum(ids[x], ids[y])), "b": pa.array(np.maximum(ids[x], ids[y])), "d": pa.array(d)})

    return _hash_tiles(rows, distance).groupBy("user_id", "i", "j").applyInArrow(look, "user_id bigint, a bigint, b bigint, d int")


def first_near(rows: DataFrame, distance: int) -> DataFrame:
    """(user_id, id, to) of each hash (user_id, id, h, first) that has another at most ``distance`` away: to is, of these and itself, the
    one with the least (first, id). Tiles send one row for each of their hashes, however many are near."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = pa.Table.from_batches(batches)
        user, ids, first = tile.column("user_id")[0].as_py(), tile.column("id").to_numpy(), tile.column("first").to_numpy()
        order = np.lexsort((ids, first))
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.arange(len(ids))
        best = np.full(len(ids), len(ids))
        for x, y in _near_in_tile(tile, distance):
            np.minimum.at(best, x, rank[y])
            np.minimum.at(best, y, rank[x])
        found = np.flatnonzero(best < len(ids))
        to = order[np.minimum(best, rank)[found]]
        yield pa.RecordBatch.from_pydict({"user_id": pa.array(np.full(len(found), user, np.int64)), "id": pa.array(ids[found]), "first": pa.array(first[to]), "to": pa.array(ids[to])})

    kinds = "user_id bigint, id bigint, first bigint, to bigint"
    found = _hash_tiles(rows, distance, "first").groupBy("user_id", "i", "j").applyInArrow(look, kinds)
    return found.groupBy("user_id", "id").agg(F.min(F.struct("first", "to"))["to"].alias("to"))


def star_groups(pairs: DataFrame) -> DataFrame:
    """(user_id, seed, id): seeds in order of id take all their larger neighbours (pairs a < b) that no earlier seed took.

    So an id leads unless a smaller neighbour leads. Rounds of joins settle it: an id whose smaller neighbours are all settled
    and don't lead, leads; its neighbours don't. Each id then belongs to its smallest leading neighbour. No user's links meet
    in one task.
    """
    links = kept(pairs.select("user_id", "a", "b").distinct())
    open_ = kept(links.select("user_id", F.explode(F.array("a", "b")).alias("id")).distinct())
    leads = None
    left = links
    while not open_.isEmpty():
        behind = left.select("user_id", F.col("b").alias("id")).distinct()
        new = kept(open_.join(behind, ["user_id", "id"], "left_anti"))
        leads = new if leads is None else leads.unionByName(new)
        taken = left.join(new.withColumnRenamed("id", "a"), ["user_id", "a"]).select("user_id", F.col("b").alias("id")).distinct()
        gone = kept(new.unionByName(taken))
        open_ = kept(open_.join(gone, ["user_id", "id"], "left_anti"))
        for side in ("a", "b"):  # links of settled ids have no say any more
            left = left.join(gone.withColumnRenamed("id", side), ["user_id", side], "left_anti")
        left = kept(left)
    if leads is None:
        return pairs.select("user_id", F.col("a").alias("seed"), F.col("b").alias("id")).limit(0)
    members = links.join(leads.withColumnRenamed("id", "a"), ["user_id", "a"]).groupBy("user_id", F.col("b").alias("id")).agg(F.min("a").alias("seed"))
    members = kept(members.select("user_id", "seed", "id"))
    return members.unionByName(members.select("user_id", "seed", F.col("seed").alias("id")).distinct())


def most_alike(vectors: DataFrame, query: list[float], least: float, k: int) -> DataFrame:
    """(id, similarity) of unit vectors (id, embedding), best first: products in Arrow batches, then a top-k per task."""
    q = np.array(query, np.float64)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            s = flat.reshape(batch.num_rows, -1) @ q
            keep = np.flatnonzero(s >= least)
            yield pa.RecordBatch.from_pydict({"id": batch.column("id").take(pa.array(keep)), "similarity": pa.array(s[keep])})

    fits = vectors.where(F.size("embedding") == len(query)).select("id", "embedding")
    return fits.mapInArrow(task, "id bigint, similarity double").orderBy(F.round("similarity", 9).desc(), F.col("id").desc()).limit(k)


def centroids(faces: DataFrame) -> DataFrame:
    """(user_id, cluster_id, place, mean) of each cluster's vectors, one row a place. Tasks send a sum for each cluster of a batch; vectors
    with a null in them, or none, are left out."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("embedding").value_lengths().to_numpy(zero_copy_only=False)
            flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            first = np.cumsum(sizes) - sizes
            user, cluster = batch.column("user_id").to_numpy(zero_copy_only=False), batch.column("cluster_id").to_numpy(zero_copy_only=False)
            order = np.lexsort((sizes, cluster, user))
            key = np.stack([user[order], cluster[order], sizes[order]])
            new = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)])) if len(order) else np.zeros(0, np.int64)
            sums = []
            for a, b in zip(new, np.append(new[1:], len(order)), strict=True):
                own = order[a:b]
                sums.append(flat[first[own][:, None] + np.arange(sizes[own[0]])[None, :]].sum(axis=0).tolist())
            yield pa.RecordBatch.from_pydict({"user_id": pa.array(user[order][new]), "cluster_id": pa.array(cluster[order][new]), "n": pa.array(np.diff(np.append(new, len(order)))), "sums": pa.array(sums, pa.list_(pa.float64()))})

    whole = faces.where("user_id IS NOT NULL AND cluster_id IS NOT NULL AND size(embedding) > 0").where(F.forall("embedding", lambda x: x.isNotNull()))
    parts = whole.select(F.col("user_id").cast("bigint").alias("user_id"), F.col("cluster_id").cast("bigint").alias("cluster_id"), "embedding").mapInArrow(task, "user_id bigint, cluster_id bigint, n bigint, sums array<double>")
    each = parts.select("user_id", "cluster_id", "n", F.posexplode("sums").alias("place", "v"))
    return each.groupBy("user_id", "cluster_id", "place").agg((F.sum("v") / F.sum("n")).alias("mean"))


def cluster_distances(faces: DataFrame, most: float | None = None) -> DataFrame:
    """(user_id, a, b, distance) of a user's clusters a < b: the least cosine distance between their faces (unit vectors); with ``most``, of
    those at most so far apart, so that no others leave a tile.

    Products of tiles as matrices, and of each tile the least for each two clusters; only these meet.
    """

    def look(tile: pa.Table) -> pa.Table:
        cluster = tile.column("cluster_id").to_numpy()
        flat = tile.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        left, right = _sides(tile)
        v = flat.reshape(len(cluster), -1)
        order_l, order_r = left[np.argsort(cluster[left], kind="stable")], right[np.argsort(cluster[right], kind="stable")]
        d = 1 - v[order_l] @ v[order_r].T
        cl, at_l = np.unique(cluster[order_l], return_index=True)
        cr, at_r = np.unique(cluster[order_r], return_index=True)
        least = np.minimum.reduceat(np.minimum.reduceat(d, at_l, axis=0), at_r, axis=1)
        x, y = np.nonzero((cl[:, None] != cr[None, :]) & (least <= (np.inf if most is None else most)))
        a, b = cl[x], cr[y]
        return pa.Table.from_pydict({"user_id": pa.array(np.full(len(a), tile.column("user_id")[0].as_py(), np.int64)), "a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b)), "distance": pa.array(least[x, y])})

    own = tiles(faces.where("cluster_id IS NOT NULL AND embedding IS NOT NULL").select("user_id", F.col("face_id").alias("id"), "cluster_id", "embedding"))
    found = own.groupBy("user_id", "i", "j").applyInArrow(look, "user_id bigint, a bigint, b bigint, distance double")
    return found.groupBy("user_id", "a", "b").agg(F.min("distance").alias("distance"))


def overlaps(old: DataFrame, new: DataFrame) -> DataFrame:
    """(old, new, common, iou) of clusterings (cluster_id, face_id) that share faces."""
    a, b = old.select(F.col("cluster_id").alias("old"), "face_id"), new.select(F.col("cluster_id").alias("new"), "face_id")
    na, nb = a.groupBy("old").agg(F.count("*").alias("na")), b.groupBy("new").agg(F.count("*").alias("nb"))
    common = a.join(b, "face_id").groupBy("old", "new").agg(F.count("*").alias("common"))
    return common.join(na, "old").join(nb, "new").select("old", "new", "common", (F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))).alias("iou"))


def components(links: DataFrame) -> DataFrame:
    """(user_id, id, root) of all ids in ``links`` (user_id, a, b): root is the smallest id that links lead to.

    Large and small stars in turn until no edge moves: each round is an aggregation and a join by id.
    """
    edges = kept(links.where("a <> b").select("user_id", F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    mark = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("user_id", "a", "b"))).first())
    while (now := mark(edges)) != state:
        state = now
        both = edges.unionByName(edges.select("user_id", F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("user_id", "a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, ["user_id", "a"]).where("b > a").select("user_id", F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = kept(large)
        least = large.groupBy("user_id", "a").agg(F.min("b").alias("m"))
        small = large.join(least, ["user_id", "a"]).where("b <> m").select("user_id", F.col("b").alias("a"), F.col("m").alias("b"))
        edges = kept(small.unionByName(least.select("user_id", "a", F.col("m").alias("b"))).distinct())
    members = edges.select("user_id", F.col("a").alias("id"), F.col("b").alias("root"))
    return members.unionByName(members.select("user_id", F.col("root").alias("id"), "root").distinct())


def clusters_merged(faces: DataFrame, threshold: float = 0.4) -> DataFrame:
    """(user_id, cluster_id, merged_id) of all clusters: chains of clusters that have faces at most ``threshold`` apart are one, with the
    smallest of their ids."""
    near = cluster_distances(faces, threshold)
    roots = components(near).select("user_id", F.col("id").alias("cluster_id"), "root")
    own = faces.where("cluster_id IS NOT NULL").select("user_id", "cluster_id").distinct()
    return own.join(roots, ["user_id", "cluster_id"], "left").select("user_id", "cluster_id", F.coalesce("root", "cluster_id").alias("merged_id"))


def noise_apart(faces: DataFrame) -> DataFrame:
    """``faces`` where each one of cluster -1 is a cluster of its own, numbered by face after the user's largest."""
    last = faces.groupBy("user_id").agg(F.greatest(F.max("cluster_id"), F.lit(-1)).alias("__last"))
    noise = numbered(faces.where("cluster_id = -1"), "user_id", "face_id").join(last, "user_id")
    own = noise.withColumn("cluster_id", F.col("__last") + 1 + F.col("k")).select(*faces.columns)
    return faces.where("cluster_id <> -1 OR cluster_id IS NULL").unionByName(own)


def matched(pairs: DataFrame) -> DataFrame:
    """Of ``pairs`` (user_id, old, new, iou, ...) the greedy one-to-one choice: by falling iou, then old, then new.

    In each round the pairs that are first both among those of their old and of their new one are chosen, and what they use goes.
    """
    order = F.struct((-F.col("iou")).alias("r"), "old", "new")
    left, chosen = kept(pairs), None
    while not left.isEmpty():
        firsts = [left.groupBy("user_id", side).agg(F.min(order).alias(f"__{side}")) for side in ("old", "new")]
        best = left.join(firsts[0], ["user_id", "old"]).join(firsts[1], ["user_id", "new"]).where((F.col("__old") == order) & (F.col("__new") == order))
        best = kept(best.select(*pairs.columns))
        chosen = best if chosen is None else chosen.unionByName(best)
        for side in ("old", "new"):
            left = left.join(best.select("user_id", side), ["user_id", side], "left_anti")
        left = kept(left.select(*pairs.columns))
    return left if chosen is None else chosen


def names_carried(old: DataFrame, new: DataFrame, threshold: float = 0.6) -> DataFrame:
    """(user_id, new, old, name): named clusters of ``old`` (user_id, cluster_id, face_id, name) and the clusters of ``new`` that take their
    names: both share at least ``threshold`` of their faces, and each has one partner."""
    names = old.groupBy("user_id", F.col("cluster_id").alias("old")).agg(F.max(F.expr("nullif(trim(name), '')")).alias("name"), F.count_distinct("face_id").alias("na")).where("name IS NOT NULL")
    sizes = new.groupBy("user_id", F.col("cluster_id").alias("new")).agg(F.count_distinct("face_id").alias("nb"))
    a, b = (df.select("user_id", F.col("cluster_id").alias(c), "face_id").distinct() for df, c in ((old, "old"), (new, "new")))
    common = a.join(b, ["user_id", "face_id"]).groupBy("user_id", "old", "new").agg(F.count("*").alias("n"))
    both = common.join(names, ["user_id", "old"]).join(sizes, ["user_id", "new"]).where((F.col("n") >= threshold * F.col("na")) & (F.col("n") >= threshold * F.col("nb")))
    scored = both.select("user_id", "old", "new", "name", (F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))).alias("iou"))
    return matched(scored).select("user_id", "new", "old", "name")


def near_duplicates(media: DataFrame, score: Column, distance: int = 8, seeds: bool = True) -> DataFrame:
    """(user_id, group_id, id, rank_score, similarity, is_primary) of media whose 64-bit hashes (image_phash, hex) are near.

    Seeds take all later rows at most ``distance`` bits away that no earlier seed took; rows with the same first 8 digits come
    together, at the place of the first of them by id. Without ``seeds`` each row that has another so near goes to the first row, by place,
    that is near it, whichever group that one is in. Where near rows have the same neighbours both are one; else a row that is near to
    a member of a group, but not to its seed, is in a group named by that member. Equal hashes count as one row until the end, so
    copies make no pairs. Of a group the row with the best ``score``, then time, then id is primary; others are compared with it.
    group_id is the id of the seed or first row.
    """
    rows = media.withColumn("__h", hex_bits(F.trim("image_phash"))).where("__h IS NOT NULL")
    rows = rows.select("user_id", "id", F.col("__h").alias("h"), score.alias("rank_score"), F.col("created_at").alias("at"))
    hashes = rows.groupBy("user_id", "h").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    prefix = F.shiftrightunsigned(F.col("h"), 32)
    first = hashes.groupBy("user_id", prefix.alias("p")).agg(F.min("id").alias("first"))
    placed = kept(hashes.withColumn("p", prefix).join(first, ["user_id", "p"]).select("user_id", "id", "h", "copies", "first"))
    if seeds:
        links = hamming_pairs(placed.select("user_id", "id", "h"), distance)
        for side in ("a", "b"):
            links = links.join(placed.select("user_id", F.col("id").alias(side), F.struct("first", "id").alias("__" + side)), ["user_id", side])
        stars = star_groups(links.select("user_id", F.least("__a", "__b").alias("a"), F.greatest("__a", "__b").alias("b")))
        groups = stars.select("user_id", F.col("id.id").alias("id"), F.col("seed.id").alias("to"))
    else:
        groups = first_near(placed.select("user_id", "id", "h", "first"), distance)
    # a hash that is in no group is left out, unless it has copies
    classes = placed.join(groups, ["user_id", "id"], "left").where("to IS NOT NULL OR copies > 1").select("user_id", "h", F.coalesce("to", "id").alias("group_id"))
    members = kept(rows.join(classes, ["user_id", "h"]))
    primary = members.groupBy("user_id", "group_id").agg(F.max(F.struct("rank_score", "at", "id", "h")).alias("best"))
    own = members.join(primary, ["user_id", "group_id"])
    return own.select("user_id", "group_id", "id", "rank_score", hash_similarity(F.col("h"), F.col("best.h")).alias("similarity"), (F.col("id") == F.col("best.id")).alias("is_primary"))
