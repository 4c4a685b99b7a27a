"""Flows of a library's tables with their own rules: trash, albums, states, groups, search documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.operators import search, tables


def restored(media: DataFrame, ids: DataFrame) -> DataFrame:
    """Deleted media of ``ids`` (id) are live again; others stay as they are."""
    back = ids.select("id", F.lit(True).alias("__back")).where("id IS NOT NULL").distinct()
    live = F.when(F.col("__back").isNull(), F.col("deleted_at"))
    return media.join(back, "id", "left").select(*(live.alias(c) if c == "deleted_at" else c for c in media.columns))


def purged(media: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """The media without those in the trash (of ``ids`` only, if given). Live media never go."""
    gone = media.where("deleted_at IS NOT NULL").select("id")
    return tables.delete(media, gone if ids is None else gone.join(ids.select("id"), "id", "left_semi"))


def added(edges: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (album_id, media_id, added_at) with the wanted ones that are new, the earliest of repeated ones; and per album how many
    of the wanted ones were added and how many skipped."""
    one = wanted.groupBy("album_id", "media_id").agg(F.min("added_at").alias("added_at"), F.count("*").alias("__n"))
    known = edges.select("album_id", "media_id", F.lit(True).alias("__known")).distinct()
    marked = one.join(known, ["album_id", "media_id"], "left")
    new = F.col("__known").isNull()
    counts = marked.groupBy("album_id").agg(F.count_if(new).alias("added"), (F.sum("__n") - F.count_if(new)).alias("skipped"))
    return edges.unionByName(marked.where(new).select(*edges.columns)), counts


#: The states a stage may end in.
STATES = {"ingest": ("success", "failed"), "primary": ("success", "failed"), "cloud": ("success", "failed", "skipped"), "geocode": ("success", "failed", "skipped")}


def with_status(media: DataFrame, rows: DataFrame, stage: str, column: str) -> DataFrame:
    """Sets ``column`` from rows (id, status); states that the stage doesn't know are passed over."""
    fit = rows.where(F.col("status").isin(*STATES[stage])).select("id", F.col("status").alias(column))
    return tables.patch(media, fit, ["id"], [column])


def groups_refreshed(members: DataFrame, live: DataFrame, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """Groups (group_id, member_count) that still have ``least`` live members, and the members (group_id, media_id, ...) of them."""
    own = members.join(live.select(F.col("id").alias("media_id")).distinct(), "media_id", "left_semi")
    groups = own.groupBy("group_id").agg(F.count_distinct("media_id").alias("member_count")).where(F.col("member_count") >= least)
    return groups, own.join(groups.select("group_id"), "group_id", "left_semi").select(*members.columns)


def documents_rebuilt(store: DataFrame, media: DataFrame, fields: dict[str, str]) -> DataFrame:
    """The search documents (media_id, user_id, a column a field, terms) after a change of ``media`` (id, user_id, deleted_at and the
    columns of ``fields``): documents of deleted media go, those of live ones are written anew, all others stay."""
    text = lambda c: F.coalesce(F.trim(F.col(c)), F.lit(""))
    terms = F.array_distinct(F.flatten(F.array(*(search.terms(text(c)) for c in fields.values()))))
    new = media.where("deleted_at IS NULL").select(F.col("id").alias("media_id"), "user_id", *(text(c).alias(f) for f, c in fields.items()), F.array_join(terms, " ").alias("terms"))
    kept = store.join(media.select(F.col("id").alias("media_id")), "media_id", "left_anti")
    return kept.select(*store.columns).unionByName(tables.single(new, ["media_id"]).select(*store.columns))


def albums_found(albums: DataFrame, text: str = "", without: int | None = None, columns: tuple[str, ...] = ("name",)) -> DataFrame:
    """Albums with ``text`` in one of ``columns`` (case of ASCII letters aside), but not ``without``; % and _ are plain characters."""
    has = F.lit(False)
    for c in columns:
        has = has | F.coalesce(F.contains(F.lower(c), F.lit(text.strip().lower())), F.lit(False))
    found = albums.where(has) if text.strip() else albums
    return found if without is None else found.where(F.col("id") != without)


def names_taken(albums: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted names (user_id, name, id: the album's own, or null) that another album of the user has."""
    other = albums.select("user_id", "name", F.col("id").alias("__id"))
    same = (wanted["user_id"] == other["user_id"]) & (wanted["name"] == other["name"]) & ~wanted["id"].eqNullSafe(other["__id"])
    return wanted.join(other, same, "left_semi")


def albums_created(albums: DataFrame, wanted: DataFrame, at: int) -> DataFrame:
    """``albums`` (id, user_id, name, ..., created_at, updated_at, deleted_at) with ``wanted`` (id, user_id, name) whose name is not blank and that no live album of the
    user has; of wanted ones with one name the smallest id."""
    live = albums.where("deleted_at IS NULL")
    fit = wanted.withColumn("name", F.trim("name")).where("name <> ''")
    one = fit.groupBy("user_id", "name").agg(F.min("id").alias("id"))
    new = one.join(names_taken(live, one), ["user_id", "name"], "left_anti")
    filled = {"id": F.col("id"), "user_id": F.col("user_id"), "name": F.col("name"), "created_at": F.lit(at).cast("bigint"), "updated_at": F.lit(at).cast("bigint"), "media_count": F.lit(0).cast("bigint")}
    return albums.unionByName(new.select(*(filled.get(c, F.lit(None)).cast(albums.schema[c].dataType).alias(c) for c in albums.columns)))


def covers_set(albums: DataFrame, edges: DataFrame, media: DataFrame, wanted: DataFrame) -> DataFrame:
    """``albums`` with covers by hand, from ``wanted`` (id, cover_media_id): only where the media is live and in the album."""
    there = edges.join(media.where("deleted_at IS NULL").select(F.col("id").alias("media_id")), "media_id", "left_semi")
    fit = wanted.join(there.select(F.col("album_id").alias("id"), F.col("media_id").alias("cover_media_id")), ["id", "cover_media_id"], "left_semi")
    return tables.patch(albums, fit, ["id"], ["cover_media_id"])


def removed(edges: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges without the wanted ones (album_id, media_id), and the albums (album_id, removed) that lost some."""
    gone = edges.join(wanted.select("album_id", "media_id").distinct(), ["album_id", "media_id"], "left_semi")
    return edges.join(wanted.select("album_id", "media_id"), ["album_id", "media_id"], "left_anti").select(*edges.columns), gone.groupBy("album_id").agg(F.count("*").alias("removed"))


def albums_refreshed(albums: DataFrame, edges: DataFrame, media: DataFrame, touched: DataFrame) -> DataFrame:
    """``albums`` where those of ``touched`` (album_id) have their number of live media and, as cover, what they had if it is still among
    these, else the one added last (null without any)."""
    live = edges.join(media.where("deleted_at IS NULL").select(F.col("id").alias("media_id")), "media_id", "left_semi")
    own = touched.select(F.col("album_id").alias("id")).distinct().withColumn("__t", F.lit(True))
    stats = live.groupBy(F.col("album_id").alias("id")).agg(F.count("*").alias("__n"), F.max(F.struct("added_at", "media_id"))["media_id"].alias("__latest"))
    stays = live.select(F.col("album_id").alias("id"), F.col("media_id").alias("cover_media_id"), F.lit(True).alias("__stays")).distinct()
    joined = albums.join(own, "id", "left").join(stats, "id", "left").join(stays, ["id", "cover_media_id"], "left")
    changed = {"media_count": F.coalesce("__n", F.lit(0)), "cover_media_id": F.when(F.col("__stays"), F.col("cover_media_id")).otherwise(F.col("__latest"))}
    return joined.select(*(F.when(F.col("__t"), changed[c]).otherwise(F.col(c)).cast(albums.schema[c].dataType).alias(c) if c in changed else F.col(c) for c in albums.columns))
