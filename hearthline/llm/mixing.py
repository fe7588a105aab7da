"""Mixing sources to target weights, by DataFrame operations alone.

Sizes are summed per source, which combines on the map side. Sources in code-point order
(null last) take the weights in turn and share the total; a source stops at ``LIMIT`` times
its size and the excess goes to the others by weight, until nobody is above. The rate of a
source is its target over its size: every document is emitted floor(rate) times, and once
more if a uniform number made from a hash of its id lies below the fraction.

Only one row of sums per round comes to the driver; ranks come from a range partitioning
and the number of sources in each part, so the number of sources is not bounded by a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthline.llm.common import columns_besides
from hearthline.session import staged

WEIGHTS = (5, 2, 1)
LIMIT = 3
WORD = r"[^\x20\x09-\x0D]+"
SEED = "mix-1"
WIDE = "decimal(38,0)"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(identity: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the first 13 hexadecimal digits of a hash; null counts as an id."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(identity.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _ranked(sources: DataFrame) -> DataFrame:
    """Add rank, from 0, in code-point order of the source, null last."""
    spark = sources.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    last = F.col("_source").isNull()
    placed = sources.repartitionByRange(parts, last, "_source").withColumn("part", F.spark_partition_id())
    placed = staged(placed, "sources")
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("part").orderBy(F.col("_source").asc_nulls_last())
    return placed.join(offsets, "part").withColumn("rank", F.col("offset") + F.row_number().over(within) - 1)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """(_source, source_size, target) from (_source, source_size); targets sum to all sizes.

    Sources without words have target 0. An empty table gives an empty one.
    """
    turns = F.array(*[F.lit(w) for w in weights])
    ranked = _ranked(sizes).select(
        "_source",
        "source_size",
        F.element_at(turns, (F.col("rank") % len(weights) + 1).cast("int")).cast("long").alias("weight"),
        (F.col("source_size") * limit).alias("cap"),
    )
    ranked = staged(ranked, "weights")
    total = ranked.agg(F.sum(F.col("source_size").cast(WIDE)).alias("n")).first()["n"] or 0
    rest, share, stopped = int(total), None, -1
    while True:
        # With a share of rest / share per unit of weight, these sources are above their limit.
        above = F.lit(False) if share is None else F.col("cap").cast(WIDE) * share < F.col("weight").cast(WIDE) * rest
        row = ranked.agg(
            F.count_if(above).alias("stopped"),
            F.sum(F.when(above, F.col("cap").cast(WIDE))).alias("caps"),
            F.sum(F.when(~above, F.col("weight"))).alias("weights"),
        ).first()
        if row["stopped"] == stopped:
            break
        stopped, rest, share = row["stopped"], int(total) - int(row["caps"] or 0), int(row["weights"] or 0)
        if not share:
            break
    if not share:
        target = F.col("cap").cast("double")
    else:
        free = F.col("weight").cast("double") * F.lit(float(rest)) / F.lit(float(share))
        target = F.when(F.col("cap").cast(WIDE) * share < F.col("weight").cast(WIDE) * rest, F.col("cap").cast("double")).otherwise(free)
    return ranked.select("_source", "source_size", target.alias("target"))


def _chosen(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], limit: int) -> DataFrame:
    """(_doc, size, source_size, target, copies), the columns of docs within the first."""
    whole = F.struct(*[F.col(f"`{n}`") for n in docs.columns])
    sized = docs.select(
        whole.alias("_doc"), F.col(f"`{source_col}`").alias("_of"), F.col(f"`{id_col}`").alias("_id"),
        word_count(F.col(f"`{text_col}`")).alias("size"),
    )
    sums = sized.groupBy(F.col("_of").alias("_source")).agg(F.sum("size").alias("source_size"))
    targets = source_targets(sums, weights, limit)
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    whole_part = F.floor(rate)
    once_more = (uniform(F.col("_id")) < rate - whole_part).cast("long")
    keyed = sized.join(targets, F.col("_of").eqNullSafe(F.col("_source")), "left")
    return keyed.select("_doc", "size", "source_size", "target", (whole_part + once_more).alias("copies"))


def mixture(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT,
) -> DataFrame:
    """The rows of docs with ``size``, ``source_size``, ``target`` and ``copies``.

    Columns of these names in docs give way to them. Null and empty texts have size 0. Rows with
    the same id get the same decision; rows without one are told apart by nothing and share it too.
    """
    results = ("size", "source_size", "target", "copies")
    own = [F.col(f"_doc.`{n}`") for n in columns_besides(docs, *results)]
    return _chosen(docs, id_col, text_col, source_col, weights, limit).select(*own, *results)


def mixed(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT,
) -> DataFrame:
    """Every document as often as the mixture takes it, with all columns of docs as they are."""
    chosen = _chosen(docs, id_col, text_col, source_col, weights, limit).where("copies > 0")
    repeated = chosen.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return repeated.select("_doc.*")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
), sums AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank
  FROM sized GROUP BY source
), weighed AS (
  SELECT *, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS cap,
         sum(source_size) OVER () AS total
  FROM sums
), levels AS (
  SELECT *, total - coalesce(sum(cap) OVER lower, 0) AS rest, sum(weight) OVER higher AS share
  FROM weighed
  WINDOW lower AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         higher AS (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), level AS (
  SELECT CAST(rest AS DOUBLE) AS rest, CAST(share AS DOUBLE) AS share
  FROM levels WHERE cap * share >= weight * rest ORDER BY cap / weight, rank LIMIT 1
), targets AS (
  SELECT w.source, w.source_size,
         CASE WHEN w.cap * l.share < w.weight * l.rest THEN CAST(w.cap AS DOUBLE)
              ELSE CAST(w.weight AS DOUBLE) * l.rest / l.share END AS target
  FROM weighed w CROSS JOIN level l
), rated AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         CASE WHEN t.source_size = 0 THEN 0.0 ELSE t.target / t.source_size END AS rate,
         CAST(CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(s.doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS DOUBLE)
           / 4503599627370496.0 AS draw
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM rated
"""
