"""Mixing sources to target weights with hash-threshold histograms.

Every document gets a 60-bit hash of its id and text, and rows alike in both one each.  A source's partial epoch is the set of its documents
whose hash lies under the source's threshold, so that thresholds for smaller budgets select subsets
of those for larger ones.  The threshold is found level by level: token sums by source and by the next
12 bits of the hash, the bucket in which the running sum passes the budget, then the same inside that
bucket only.  Nothing is sorted but at most 4096 sums of one source.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

#: Separators between words: space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
LEVEL_BITS, LEVELS, HASH_BITS = 12, 5, 60
MAX_EPOCHS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _bits(text: Column) -> Column:
    """60 bits of the MD5 of a text."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def row_hash(doc_id: Column, text: Column) -> Column:
    """60 bits of the MD5 of the id's decimal text (nothing for a null id), a colon and the MD5 of the text (of the empty one for a null text)."""
    return _bits(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")))))


def with_own_hashes(rows: DataFrame) -> DataFrame:
    """``rows`` (source, h, ...) with hashes of their own where rows of a source share one: of those, numbered from 0, each but number 0 gets 60 bits of ``h:number``.

    Which of the rows gets which number doesn't matter, as they are alike.  Numbers run through parts of a group that lie in different
    partitions, each counted from where the part before ends, so a group of any size is numbered by many tasks.
    """
    keyed = rows.withColumn("source_key", F.md5(F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))))
    ties = stored(keyed.groupBy("source_key", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "mix-ties")
    if ties.isEmpty():
        return rows
    tied = stored(keyed.join(ties, ["source_key", "h"]).withColumn("at", F.monotonically_increasing_id()), "mix-tied")
    part = F.shiftright("at", 20)
    counts = tied.groupBy("source_key", "h", part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("source_key", "h").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(W.partitionBy("source_key", "h", "part").orderBy("at")) - 1
    numbered = tied.withColumn("part", part).withColumn("inside", inside).join(counts.withColumn("before", before).drop("n"), ["source_key", "h", "part"])
    number = F.col("before") + F.col("inside")
    own = numbered.withColumn("h", F.when(number == 0, F.col("h")).otherwise(_bits(F.concat_ws(":", "h", number))))
    return keyed.join(ties, ["source_key", "h"], "left_anti").select(*rows.columns).unionAll(own.select(*rows.columns))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: source, source_size, target.

    Sources in code-point order, null last, weigh ``weights`` in turn and share the total size; no target
    exceeds ``max_epochs`` times its source's size, and what that cuts off is shared again by weight.  The
    fixed point of that resharing is ``min(cap, level * weight)`` with one common level, which a running sum
    over the sources in the order of ``cap / weight`` gives at once.  Only source totals meet here.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    by = by.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("double"))
    by = by.withColumn("cap", F.col("source_size").cast("double") * max_epochs).withColumn("fills_at", F.col("cap") / F.col("weight"))
    filled = W.orderBy("fills_at", F.col("source").isNull(), F.col("source").cast("binary"))
    before, whole = filled.rowsBetween(W.unboundedPreceding, -1), W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.sum(F.col("source_size").cast("double")).over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    heavy = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    by = by.withColumn("level", left / heavy)
    #: A source stays capped while the level that would remain for it is at least where it fills up.
    stops = F.first(F.when(F.col("level") < F.col("fills_at"), F.col("level")), ignorenulls=True).over(filled.rowsBetween(W.unboundedPreceding, 0))
    return by.select("source", "source_size", F.when(stops.isNull(), F.col("cap")).otherwise(stops * F.col("weight")).alias("target"))


def thresholds(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """source, source_size, target, epochs, threshold: ``epochs`` whole copies, and one more of hashes up to ``threshold``.

    The document on the boundary is in if that brings the sum nearer to the budget.
    """
    plan = targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    plan = plan.withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))
    state = plan.select("source", F.col("budget").alias("left"), F.lit(0).cast("long").alias("prefix"))
    for level in range(LEVELS):
        shift = HASH_BITS - LEVEL_BITS * (level + 1)
        inside = sizes.withColumn("up", F.shiftright("h", shift + LEVEL_BITS)).join(
            state.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")) & (F.col("up") == F.col("prefix"))
        )
        sums = inside.groupBy("source", "left", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("sum"), F.min("h").alias("low"), F.max("h").alias("high"))
        running = F.sum("sum").over(W.partitionBy("source").orderBy("bucket"))
        after = sums.withColumn("run", running.cast("double")).where(F.col("run") > F.col("left"))
        state = after.groupBy("source").agg(F.min_by(F.struct("bucket", (F.col("left") - F.col("run") + F.col("sum")).alias("left"), "sum", "low", "high"), "bucket").alias("b"))
        state = stored(state.select("source", F.col("b.left").alias("left"), F.col("b.bucket").alias("prefix"), F.col("b.sum").alias("sum"), F.col("b.low").alias("low"), F.col("b.high").alias("high")), f"mix-level{level}")
        #: Once the boundary bucket of every source holds one hash value, further levels tell nothing new; at the last it does.
        if state.where("low != high").isEmpty():
            break
    edge = state.select(F.col("source").alias("s"), F.when(F.col("left") * 2 >= F.col("sum"), F.col("low")).otherwise(F.col("low") - 1).alias("edge"))
    whole = (1 << HASH_BITS) - 1
    plan = plan.join(edge, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    return plan.withColumn("threshold", F.coalesce("edge", F.when(F.col("budget") > 0, F.lit(whole)).otherwise(F.lit(-1)))).drop("edge", "budget")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = MAX_EPOCHS, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (doc_id, text, source) with size, source_size, target, copies and taken = copies * size.

    Null or empty texts have size 0 and are never taken but by whole copies (0 words either way).  A null
    source is a source of its own, last in order.  Rows that share an id have lots of their own, also where they share the text.  Other columns
    of ``docs`` pass through if named in ``keep``; an empty table gives an empty one.
    """
    sizes = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), row_hash(F.col("doc_id"), F.col("text")).alias("h"), *(F.col(c) for c in keep or ()))
    if keep:
        sizes = with_own_hashes(sizes)
        small = stored(sizes.select("doc_id", "source", "size", "h"), "mix-sizes")
    else:
        small = with_own_hashes(stored(sizes, "mix-sizes"))
    plan = stored(thresholds(small, source_targets(small, weights, max_epochs)), "mix-plan").withColumnRenamed("source", "s")
    out = (sizes if keep else small).join(plan, F.col("source").eqNullSafe(F.col("s")))
    out = out.withColumn("copies", F.col("epochs") + (F.col("h") <= F.col("threshold")).cast("long"))
    return out.withColumn("taken", F.col("copies") * F.col("size")).drop("s", "h", "epochs", "threshold")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mixture itself: the columns of ``docs``, each row as often as the mix takes it (size-0 rows not at all).

    (doc_id, text, source) are read; the others pass through, whatever their names.  Null and empty texts have size 0; a null source is a
    source of its own; rows that share an id have lots of their own; an empty table gives an empty one.
    """
    whole = docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("whole_row"))
    out = mix(whole, weights, max_epochs, keep=["whole_row"])
    out = out.where((F.col("copies") > 0) & (F.col("size") > 0)).select("whole_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select(*(F.col("whole_row").getField(c).alias(c) for c in docs.columns))


_HEX = "('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT"
SQL = f"""
WITH RECURSIVE h0 AS (
  SELECT doc_id, source, {_HEX} AS h,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s AS (SELECT doc_id, source, size, CASE WHEN k = 0 THEN h ELSE ('0x' || substr(md5(h || ':' || k), 1, 15))::BIGINT END AS h
      FROM (SELECT *, row_number() OVER (PARTITION BY source, h) - 1 AS k FROM h0)),
b AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             1 + (row_number() OVER (ORDER BY source IS NULL, CAST(source AS BLOB)) - 1) % 3 AS w
      FROM s GROUP BY source),
pool(n, source, source_size, w, target, capped) AS (
  SELECT 0, source, source_size, w,
         least(3.0 * source_size, CAST(sum(source_size) OVER () AS DOUBLE) * w / sum(w) OVER ()),
         3.0 * source_size <= CAST(sum(source_size) OVER () AS DOUBLE) * w / sum(w) OVER ()
  FROM b
  UNION ALL
  SELECT n + 1, source, source_size, w,
         CASE WHEN capped OR 3.0 * source_size <= lvl * w THEN 3.0 * source_size ELSE lvl * w END,
         capped OR 3.0 * source_size <= lvl * w
  FROM (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(3.0 * source_size) FILTER (WHERE capped) OVER (), 0))
                  / sum(w) FILTER (WHERE NOT capped) OVER () AS lvl
        FROM pool WHERE n < 60) q),
t AS (SELECT source, source_size, CAST(target AS DOUBLE) AS target,
             CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs
      FROM pool WHERE n = 60),
g AS (SELECT s.source, h, sum(size) AS gs FROM s GROUP BY ALL),
r AS (SELECT source, h, gs, sum(gs) OVER (PARTITION BY source ORDER BY h) AS run FROM g)
SELECT s.doc_id, s.size, t.source_size, round(t.target, 6) AS target,
       CAST(s.size * (t.epochs + CASE WHEN t.target - t.epochs * t.source_size > 0
            AND ((r.run <= t.target - t.epochs * t.source_size)
              OR (r.run - r.gs <= t.target - t.epochs * t.source_size
                  AND 2 * (t.target - t.epochs * t.source_size - r.run + r.gs) >= r.gs)) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source JOIN r ON s.source IS NOT DISTINCT FROM r.source AND s.h = r.h
"""
