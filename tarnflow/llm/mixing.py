"""Mixing sources to target weights by capped water-filling (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnflow.llm.common import materialize

#: Maximal runs of anything but ASCII white space count as words.
WORD = r"[^\x20\x09-\x0D]+"


def water_fill(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """Targets of sources under a cap of ``max_epochs`` times their size.

    ``sources`` has ``source`` (null allowed) and ``source_size``, one row each.
    Weights repeat in code-point order of the names, null last. Sources are
    clamped in the order in which a rising water level reaches their caps; the
    level is what the clamped ones leave, divided by the weight of the others,
    so the result is the fixed point of "clamp, reshare the excess by weight".
    An empty table gives an empty table; when all sizes are 0 so are the targets.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("rank", F.row_number().over(by_name))
    choices = F.array(*[F.lit(float(w)) for w in weights])
    weighted = ranked.withColumn("weight", F.element_at(choices, (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")))
    weighted = weighted.withColumn("cap", F.col("source_size") * F.lit(max_epochs))
    everything = Window.partitionBy()
    reached = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = reached.rowsBetween(Window.unboundedPreceding, -1)
    levels = (
        weighted.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("total_weight", F.sum("weight").over(everything))
        .withColumn("clamped", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("clamped_weight", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("clamped")) / (F.col("total_weight") - F.col("clamped_weight")))
    )
    # The first source whose own cap is not reached fixes the level of all after it.
    dry = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    return levels.withColumn("final", F.first(dry, ignorenulls=True).over(reached.rowsBetween(Window.unboundedPreceding, Window.currentRow))).select(
        "source",
        "source_size",
        F.coalesce(F.col("final") * F.col("weight"), F.col("cap").cast("double")).alias("target"),
    )


def draw_of(doc_id: Column, text: Column, seed: int = 7) -> Column:
    """The seeded hash of id and text by which documents of a source are ordered, 32 bits."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), doc_id.cast("string"), text)), 1, 8), 16, 10).cast("long")


def planned(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    max_epochs: int = 3,
    seed: int = 7,
    buckets: int = 1024,
) -> DataFrame:
    """:func:`plan_repetitions` with ``draw, whole, most`` as well: place in the order, and repetitions after and before the source's cut.

    Every document of a source is taken the whole number
    of times that fits the target; the fraction that remains goes to documents in
    the order of a seeded hash of id and text, until their words reach it, so a source misses
    its target by half a document at most. ``taken`` is ``size * repetitions``.

    The running sum in hash order is built from two levels, sums of
    ``buckets`` hash ranges per source and sums inside a range, so no task ever
    holds a whole source. Null or empty text has size 0 and is never short of its
    target; a null source is a source of its own; repeated rows count each; other
    columns are ignored; an empty table gives no rows.
    """
    sizes = documents.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        draw_of(F.col(id_col), F.col(text_col), seed).alias("draw"),
    )
    drawn = materialize(sizes.withColumn("bucket", F.floor(F.col("draw") * buckets / F.lit(float(1 << 32))).cast("int")), "mixing-sizes")

    ranges = drawn.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    targets = water_fill(ranges.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, max_epochs)
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.withColumn("bucket_start", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0))).alias("r")
    placed = starts.join(targets.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source"))).select(
        F.col("r.source").alias("r_source"), F.col("r.bucket").alias("r_bucket"), "bucket_start", "source_size", "target"
    )
    inside = Window.partitionBy("source", "bucket").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = drawn.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = rows.join(placed, F.col("source").eqNullSafe(F.col("r_source")) & (F.col("bucket") == F.col("r_bucket")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.col("target") - F.col("whole") * F.col("source_size")
    extra = ((F.col("bucket_start") + F.col("inside")) * 2 + F.col("size") < rest * 2).cast("long")
    most = F.lit(max_epochs).cast("long")
    return (
        joined.withColumn("whole", F.least(whole.cast("long"), most))
        .withColumn("most", F.least(F.col("whole") + 1, most))
        .withColumn("repetitions", F.least(F.col("whole") + extra, most))
        .select("doc_id", "size", "source", "source_size", "target", "repetitions", (F.col("size") * F.col("repetitions")).alias("taken"), "draw", "whole", "most")
    )


def plan_repetitions(documents: DataFrame, **options) -> DataFrame:
    """How often each document enters the mix, by the columns and bounds that :func:`planned` takes.

    Returns one row per input row: ``doc_id, size, source, source_size, target,
    repetitions, taken``.
    """
    return planned(documents, **options).select("doc_id", "size", "source", "source_size", "target", "repetitions", "taken")


def cuts_of(plan: DataFrame) -> DataFrame:
    """The plan in one row per source: ``source, fewest, most, last, split``.

    Half of a document's words and all words before it never fall in the order of the plan, so the documents
    that get one repetition more are the first ones: up to ``last``, a draw and an id. Rows with one draw and
    id may lie on both sides of the cut; then ``split`` is how often they are taken together, else null.
    """
    place, more = F.struct("draw", "doc_id"), F.col("repetitions") > F.col("whole")
    rows = plan.groupBy("source", "draw", "doc_id").agg(F.min("whole").alias("fewest"), F.max("most").alias("most"), F.max(more).alias("more"), F.when(F.min(more) != F.max(more), F.sum("repetitions")).alias("split"))
    return rows.groupBy("source").agg(
        F.min("fewest").alias("fewest"), F.max("most").alias("most"), F.max(F.when(F.col("more"), place)).alias("last"), F.max("split").alias("split")
    )


def op7(spark, sf_dir):
    """Mixes all ``documents``; see :func:`plan_repetitions`."""
    from tarnflow.llm.common import table

    return plan_repetitions(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: The same mix in one pass of window functions.
OP7_SQL = r"""
WITH sized AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(concat_ws(':', '7', doc_id::VARCHAR, text)), 1, 8))::BIGINT AS draw
  FROM documents
), per_source AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rnk FROM per_source
), weighted AS (
  SELECT *, CASE (rnk - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         source_size * 3 AS cap
  FROM ranked
), levels AS (
  SELECT *,
    (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0))::DOUBLE
      / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM weighted
  WINDOW before AS (ORDER BY cap / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size,
    coalesce(first_value(CASE WHEN level * weight <= cap THEN level END IGNORE NULLS)
               OVER (ORDER BY cap / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) * weight,
             cap::DOUBLE) AS target
  FROM levels
), placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.draw, s.doc_id NULLS FIRST, s.size
                               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier,
    CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS whole
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (size * least(whole + CASE WHEN earlier * 2 + size < (target - whole * source_size) * 2 THEN 1 ELSE 0 END, 3))::BIGINT AS taken
FROM placed
"""
