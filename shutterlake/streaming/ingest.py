"""Ingest as streams: idempotent jobs, debounced rebuilds, progress counters. The same functions take batch tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Counter that an event type raises.
COUNTERS = {"signup": "uploaded", "view": "ingest_done", "error": "ingest_error", "click": "ai_eligible", "purchase": "ai_done"}


def once(jobs: DataFrame, keys: list[str], time: str, delay: str = "1 hour") -> DataFrame:
    """Each job once, by ``keys``; on a stream, state of keys older than ``delay`` goes."""
    if jobs.isStreaming:
        return jobs.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)
    return jobs.groupBy(*keys).agg(F.min(F.col(time)).alias(time))


def debounced(jobs: DataFrame, key: str, time: str, gap: str = "60 seconds", delay: str = "10 minutes") -> DataFrame:
    """(key, started, due, jobs): one rebuild per run of jobs of a key with no pause of ``gap``, due ``gap`` after the last."""
    own = jobs.withWatermark(time, delay) if jobs.isStreaming else jobs
    return own.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("jobs")).select(key, F.col("w.start").alias("started"), F.col("w.end").alias("due"), "jobs")


def progress(events: DataFrame) -> DataFrame:
    """Counters per session, and the phase that they tell."""
    counts = events.groupBy("session_id").agg(*(F.count_if(F.col("event_type") == k).alias(c) for k, c in COUNTERS.items()))
    media = (F.col("uploaded") > 0) & (F.col("ingest_done") + F.col("ingest_error") >= F.col("uploaded"))
    ai = F.col("ai_done") >= F.col("ai_eligible")
    phase = F.when(F.col("uploaded") == 0, "uploading").when(~media, "mediaProcessing").when(~ai, "aiAnalyzing").otherwise("completed")
    return counts.withColumn("phase", phase)


def routed(uploads: DataFrame, media: DataFrame) -> DataFrame:
    """``uploads`` (user_id, hash, ...) with route and media_id against the table ``media`` (id, user_id, hash, deleted_at): "duplicate" of a
    live item, "restore" of one in the trash, else "new". Of several items with one hash a live one counts, then the smallest id.

    On a stream the table is read anew in each micro-batch, so it also holds what was there before the stream's own state began.
    """
    known = media.groupBy("user_id", "hash").agg(F.min(F.struct(F.col("deleted_at").isNotNull().alias("gone"), F.col("id").alias("media_id"))).alias("__known"))
    met = uploads.join(known, ["user_id", "hash"], "left")
    route = F.when(F.col("__known").isNull(), "new").when(F.col("__known.gone"), "restore").otherwise("duplicate")
    return met.select(*uploads.columns, route.alias("route"), F.col("__known.media_id").alias("media_id"))


def progress_once(events: DataFrame, key: str, time: str) -> DataFrame:
    """``progress`` where each (session, event type, ``key``) counts once, however often it is told."""
    return progress(once(events, ["session_id", "event_type", key], time))


def geocoded(media: DataFrame, found: DataFrame) -> DataFrame:
    """``media`` with places of ``found`` (id, country, province, city, status), where they were skipped or failed before; other rows keep
    what they have."""
    fit = media.where(F.col("map_regeo_status").isin("skipped", "failed")).select("id").join(found.groupBy("id").agg(F.max(F.struct("status", "country", "province", "city")).alias("__f")), "id")
    new = {"country": "country", "province": "province", "city": "city", "map_regeo_status": "status"}
    joined = media.join(fit, "id", "left")
    return joined.select(*(F.when(F.col("__f").isNull(), F.col(c)).otherwise(F.col(f"__f.{new[c]}")).alias(c) if c in new else c for c in media.columns))
