r"""Mixing sources to target weights by Efraimidis-Spirakis sampling. DataFrame functions only.

A source's share of the mix is set by its weight and stops at MOST times its size, the excess going to the others by weight
(``targets``, closed form over a row for each source). A target of more than a source's size takes whole epochs of it first; what
is left is taken from documents in the order of exponential keys, -ln(u) / w, u uniform from a hash of the document, w its quality
weight: a sample without replacement in which better documents come earlier. A document is in if that brings the sum of sizes
nearer to the target, so a source misses it by half a document at most.

The order is never made as a whole: sums of sizes by bucket of the key (steps of 1.1 % of it, finer ones, the key itself, then a
hash of the place of rows that share a key) find, level by level, the one bucket where the budget ends, and only its rows are put
in order. So a source may hold any share of the rows. Texts are read once; what follows reads a written table of numbers.

Defined results: a null text has size 0; sources weigh by their rank of code points, null last, and null is a source; a document
without id is one by its text; rows repeated exactly share a key and are taken one by one; without any word all targets are 0;
an empty table gives no rows; extra columns are not read. Keys come from hashes alone, so reruns agree.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shutterlake.llm.common import written

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
SEED = "mix-1"
LEAST_QUALITY = 0.05


def quality(text: Column) -> Column:
    """A weight from LEAST_QUALITY to 1 that falls with the share of ASCII digits and punctuation; an empty text has the least."""
    n = F.length(text)
    symbols = n - F.length(F.regexp_replace(text, r"[!-@\[-`{-~]", ""))
    return F.when(n > 0, F.greatest(F.lit(LEAST_QUALITY), 1 - 4 * symbols / n)).otherwise(F.lit(LEAST_QUALITY))


def keyed(docs: DataFrame, weight: Column | None = None) -> DataFrame:
    """(doc_id, source, size, x, place): x is the binary logarithm of the exponential key. ``weight`` is positive, of columns of ``docs``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    w = quality(text) if weight is None else weight
    hashed = F.md5(F.concat(F.lit(SEED + "|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.md5(text.cast("binary"))).cast("binary"))
    u = (F.conv(F.substring(hashed, 1, 13), 16, 10).cast("bigint") + 0.5) / float(1 << 52)
    size = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")
    return docs.select("doc_id", "source", size.alias("size"), F.log2(-F.log(u) / w).alias("x"), F.monotonically_increasing_id().alias("place"))


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target, epochs, rest) from a row for each source: words to take, as whole epochs and a rest below one.

    In the order of size by weight the sources whose share would pass their bound come first, so one running sum tells them.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = sizes.withColumn("nth", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    own = ranked.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("nth") % len(weights) + 1).cast("int")))
    own = own.withColumn("bound", most * F.col("source_size"))
    tight = Window.orderBy(F.col("bound") / F.col("w"), "nth")
    to_here, everything = tight.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    spent = F.coalesce(F.sum("bound").over(to_here), F.lit(0))
    own = own.withColumn("left", F.lit(float(share)) * F.sum("source_size").over(everything) - spent)
    own = own.withColumn("open", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(to_here), F.lit(0)))
    free = F.col("left") * F.col("w") <= F.col("bound") * F.col("open")
    level = F.min(F.when(free, F.struct("nth_tight", "left", "open"))).over(everything)
    own = own.withColumn("nth_tight", F.row_number().over(tight)).withColumn("level", level)
    target = F.when(F.col("level").isNull() | (F.col("nth_tight") < F.col("level.nth_tight")), F.col("bound").cast("double")).otherwise(F.least(F.col("level.left") * F.col("w") / F.col("level.open"), F.col("bound").cast("double")))
    own = own.select("source", "source_size", target.alias("target"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    return own.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))


def _levels() -> dict[str, Column]:
    """Buckets of the order, coarse to fine; rows that agree in all have one key and one hash of their places."""
    x = F.col("x")
    return {"b0": F.floor(x * 64).cast("double"), "b1": F.floor(x * 16_384).cast("double"), "b2": x, "b3": F.pmod(F.xxhash64("place"), F.lit(1 << 14)).cast("double")}


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, weight: Column | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, taken); weights by rank of source, repeating; ``weight`` of a document, else ``quality``."""
    levels = _levels()
    rows = written(keyed(docs, weight))
    plan = written(targets(rows, weights, share, most).withColumn("base", F.lit(0).cast("bigint")))
    renamed = lambda p: p.withColumnRenamed("source", "__source")
    at = rows.withColumns(levels)
    joined = lambda p: at.join(renamed(p), F.col("source").eqNullSafe(F.col("__source")))
    same, names = F.lit(True), []
    for name in levels:
        inside = joined(plan).where(same).groupBy("__source", name).agg(F.sum("size").alias("s"), F.first("base").alias("base"), F.first("rest").alias("rest"))
        upto = F.sum("s").over(Window.partitionBy("__source").orderBy(name)) + F.col("base")
        ends = inside.select("__source", F.col(name).alias("c" + name), (upto - F.col("s")).alias("start"), upto.alias("upto"), "rest").where("start <= rest AND rest < upto")
        ends = ends.select(F.col("__source").alias("ended"), "c" + name, "start")
        plan = plan.join(ends, F.col("source").eqNullSafe(F.col("ended")), "left").withColumn("base", F.coalesce("start", "base")).drop("ended", "start")
        plan = written(plan)
        names.append(name)
        same = same & (F.col(name) == F.col("c" + name))
    # without an end nothing is left to be taken (no words), or all of it is
    whole = joined(plan)
    before, so_far = F.lit(False), F.lit(True)
    for name in names:
        before = before | (so_far & (F.col(name) < F.col("c" + name)))
        so_far = so_far & (F.col(name) == F.col("c" + name))
    rank = Window.partitionBy("__source").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    edge = whole.where(F.coalesce(same, F.lit(False)))
    start = F.col("base") + F.coalesce(F.sum("size").over(rank), F.lit(0))
    parts = [whole.where(~F.coalesce(same, F.lit(False))).withColumn("in", F.coalesce(before, F.lit(False))), edge.withColumn("in", start + F.col("size") / 2 <= F.col("rest"))]
    taken = (F.col("size") * (F.col("epochs") + F.col("in").cast("bigint"))).alias("taken")
    return reduce(DataFrame.unionByName, (p.select("doc_id", "size", "source_size", "target", taken) for p in parts))


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
k AS (SELECT doc_id, source, CAST(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  CASE WHEN length(text) > 0 THEN greatest(0.05, 1 - 4 * CAST(length(text) - length(regexp_replace(text, '[!-@\[-`{-~]', '', 'g')) AS DOUBLE) / length(text)) ELSE 0.05 END AS w,
  (CAST('0x' || substr(md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(text)), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0 AS u FROM d),
x AS (SELECT *, log2(-ln(u) / w) AS x FROM k),
s AS (SELECT source, sum(size) AS source_size, 2 * sum(size) AS bound, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w,
  row_number() OVER (ORDER BY source NULLS LAST) AS nth FROM k GROUP BY source),
o AS (SELECT *, row_number() OVER t AS place, 1.5 * CAST((SELECT sum(size) FROM k) AS DOUBLE) - coalesce(sum(bound) OVER (t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
  sum(w) OVER () - coalesce(sum(w) OVER (t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open FROM s WINDOW t AS (ORDER BY bound / w, nth)),
l AS (SELECT min(place) AS place, arg_min(rest, place) AS rest, arg_min(open, place) AS open FROM o WHERE rest * w <= bound * open),
g AS (SELECT o.source, CAST(source_size AS BIGINT) AS source_size, CASE WHEN l.place IS NULL OR o.place < l.place THEN CAST(bound AS DOUBLE) ELSE least(l.rest * w / l.open, CAST(bound AS DOUBLE)) END AS target FROM o, l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM g),
r AS (SELECT x.doc_id, x.size, e.*, coalesce(sum(x.size) OVER (PARTITION BY x.source ORDER BY x.x, x.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM x JOIN e ON x.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, CAST(size * (epochs + CASE WHEN start + size / 2.0 <= target - epochs * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""
