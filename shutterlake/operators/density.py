"""Density clustering of faces, per user."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.operators.neighbours import _sides, components, tiles
from shutterlake.operators.rollups import numbered
from shutterlake.sources.shared import kept


def _near(tile: pa.Table, eps: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which rows of the tile's first block are near which of its second: (left, right, near)."""
    flat = tile.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    v = flat.reshape(len(tile), -1)
    left, right = _sides(tile)
    return left, right, 1 - v[left] @ v[right].T <= eps


def _reached(near: np.ndarray) -> np.ndarray:
    """For each column the label of the group that it is in, where rows and columns that are ``near`` are in one group; columns near no row: -1."""
    group = np.full(near.shape[1], -1)
    row_done = np.zeros(near.shape[0], bool)
    for start in range(near.shape[1]):
        if group[start] >= 0 or not near[:, start].any():
            continue
        new = np.zeros(near.shape[1], bool)
        new[start] = True
        while new.any():
            group[new] = start
            rows = ~row_done & near[:, new].any(axis=1)
            row_done |= rows
            new = (group < 0) & near[rows].any(axis=0)
    return group


def core_faces(dealt: DataFrame, eps: float, least: int) -> DataFrame:
    """(user_id, id) of faces with ``least`` faces, themselves counted, at most ``eps`` away: numbers a tile and face, summed."""

    def count(tile: pa.Table) -> pa.Table:
        left, right, near = _near(tile, eps)
        ids = tile.column("id").to_numpy()
        if tile.column("i")[0] == tile.column("j")[0]:
            ids, n = ids[left], near.sum(axis=1)
        else:
            ids, n = np.concatenate([ids[left], ids[right]]), np.concatenate([near.sum(axis=1), near.sum(axis=0)])
        return pa.Table.from_pydict({"user_id": pa.array(np.full(len(ids), tile.column("user_id")[0].as_py(), np.int64)), "id": pa.array(ids), "n": pa.array(n.astype(np.int64))})

    counts = dealt.groupBy("user_id", "i", "j").applyInArrow(count, "user_id bigint, id bigint, n bigint")
    return counts.groupBy("user_id", "id").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("user_id", "id")


def core_links(dealt: DataFrame, eps: float) -> DataFrame:
    """(user_id, a, b, core) of ``dealt`` faces (with is_core): a is a core face, b another (core) or one at the edge of its cluster.

    A tile gives, for each group of core faces that it connects, a link from one of them to each other, not all pairs, so it has no more
    links of core faces than it has core faces.
    """

    def link(tile: pa.Table) -> pa.Table:
        ids, core = tile.column("id").to_numpy(), tile.column("is_core").to_numpy(zero_copy_only=False).astype(bool)
        left, right, near = _near(tile, eps)
        one = tile.column("i")[0] == tile.column("j")[0]
        a, b, both = [], [], []

        def note(x: np.ndarray, y: np.ndarray, flag: bool) -> None:
            a.append(x)
            b.append(y)
            both.append(np.full(len(x), flag))

        cl, cr = np.flatnonzero(core[left]), np.flatnonzero(core[right])
        inner = near[np.ix_(cl, cr)]
        group = _reached(inner)  # of the right core faces; a left one is in the group of those near it
        first = inner.argmax(axis=1) if inner.size else np.zeros(len(cl), np.int64)
        group_l = np.where(inner.any(axis=1), group[first], -1) if inner.size else np.full(len(cl), -1)
        hub = ids[right[cr]]
        for side, g in ((left[cl], group_l), (right[cr], group)):
            met = g >= 0
            note(hub[g[met]], ids[side[met]], True)
        for rows, cols, m in ((left, right, near), (right, left, near.T))[: 1 if one else 2]:
            edge, middle = np.flatnonzero(~core[rows]), np.flatnonzero(core[cols])
            x, y = np.nonzero(m[np.ix_(edge, middle)])  # few: a face at the edge has fewer near ones than make a core face
            note(ids[cols[middle[y]]], ids[rows[edge[x]]], False)
        x, y, flag = (np.concatenate(c) for c in (a, b, both))
        other = x != y
        return pa.Table.from_pydict({"user_id": pa.array(np.full(int(other.sum()), tile.column("user_id")[0].as_py(), np.int64)), "a": pa.array(x[other]), "b": pa.array(y[other]), "core": pa.array(flag[other])})

    return dealt.groupBy("user_id", "i", "j").applyInArrow(link, "user_id bigint, a bigint, b bigint, core boolean")


def density_clusters(faces: DataFrame, eps: float, least: int, block: int = 2_048) -> DataFrame:
    """(user_id, face_id, cluster_id) of faces (user_id, face_id, embedding; unit vectors) by density (DBSCAN, cosine distance).

    Core faces have ``least`` faces, themselves counted, within ``eps``; chains of near core faces are a cluster, with its least core
    face's place among those of the user as number, from 0. Any other face near a core face is of the cluster with the lowest number
    that it is near; the rest are noise, -1. Faces without a vector are left out; of repeated rows of a face one counts.

    All pairs are looked at, as products of tiles of two blocks, but only numbers and links of groups leave a tile.
    """
    own = kept(faces.where("embedding IS NOT NULL").select("user_id", F.col("face_id").alias("id"), "embedding").dropDuplicates(["user_id", "id"]))
    cores = kept(core_faces(tiles(own, block), eps, least))
    marked = own.join(cores.withColumn("is_core", F.lit(True)), ["user_id", "id"], "left").withColumn("is_core", F.coalesce("is_core", F.lit(False)))
    links = kept(core_links(tiles(marked, block), eps))
    chained = components(links.where("core").select("user_id", "a", "b"))
    rooted = kept(cores.join(chained, ["user_id", "id"], "left").select("user_id", "id", F.coalesce("root", "id").alias("root")))
    edge = links.where("NOT core").join(rooted.withColumnRenamed("id", "a"), ["user_id", "a"]).groupBy("user_id", F.col("b").alias("id")).agg(F.min("root").alias("root"))
    names = numbered(rooted.select("user_id", "root").distinct(), "user_id", "root").select("user_id", "root", F.col("k").alias("cluster_id"))
    placed = rooted.unionByName(edge).join(names, ["user_id", "root"]).select("user_id", "id", "cluster_id")
    return own.select("user_id", "id").join(placed, ["user_id", "id"], "left").select("user_id", F.col("id").alias("face_id"), F.coalesce("cluster_id", F.lit(-1)).cast("bigint").alias("cluster_id"))
