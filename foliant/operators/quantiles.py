"""Exact quantiles in a few passes, whatever the number of distinct values.

A quantile lies between two order statistics. Each wanted rank starts with the range from its group's least to its
greatest value. A round counts the values of the range in bins of equal width, keeps the bin that holds the rank, and
goes on with that bin's own least and greatest value, until they are equal. A round aggregates as many rows as there are
bins for each rank, so no task holds a group's values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.session import written

#: Bins of a round; ranks up to which they go through the driver and are broadcast, instead of into a table.
BINS, FEW = 4096, 5000
#: Infinite values count as the largest finite ones.
LARGEST = 1.7976931348623157e308


def exact_quantiles(df: DataFrame, value: str, shares: list[float], by: str | None = None) -> DataFrame:
    """(by, n, share, quantile) for each group and share, interpolated between neighbours; n counts the values, null and not-a-number left out. A group without values has no row."""
    x = F.col(value).cast("double")
    rows = df.select((F.col(by) if by else F.lit(0)).alias("g_"), x.alias("x_")).where(F.col("x_").isNotNull() & ~F.isnan("x_"))
    rows = rows.withColumn("x_", F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.col("x_"))))
    groups = rows.groupBy("g_").agg(F.count("*").alias("n"), F.min("x_").alias("lo"), F.max("x_").alias("hi"))
    place = F.col("share") * (F.col("n") - 1)
    wanted = groups.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares]))).withColumn("at", F.floor(place)).withColumn("rest", place - F.floor(place))
    wanted, few = _kept(wanted)
    ranks = wanted.select("g_", "lo", "hi", F.explode(F.array("at", F.col("at") + F.when(F.col("rest") > 0, 1).otherwise(0))).alias("k")).distinct().withColumn("below", F.lit(0).cast("long"))
    ranks, few = _kept(ranks)
    while not (left := ranks.where("lo < hi")).isEmpty():
        ranks, few = _kept(ranks.where("lo >= hi").unionByName(_closer(rows, left, few)))
    low, high = (ranks.select(F.col("g_").alias(f"{side}_g"), F.col("k").alias(f"{side}_k"), F.col("lo").alias(f"{side}_x")) for side in ("low", "high"))
    out = wanted.join(low, F.col("g_").eqNullSafe(F.col("low_g")) & (F.col("at") == F.col("low_k")))
    out = out.join(high, F.col("g_").eqNullSafe(F.col("high_g")) & (F.col("at") + F.when(F.col("rest") > 0, 1).otherwise(0) == F.col("high_k")))
    found = F.when(F.col("low_x") == F.col("high_x"), F.col("low_x")).otherwise(F.col("low_x") * (1 - F.col("rest")) + F.col("high_x") * F.col("rest"))
    return out.select(*([F.col("g_").alias(by)] if by else []), "n", "share", found.alias("quantile"))


def _kept(df: DataFrame) -> tuple[DataFrame, bool]:
    """df with its lineage cut, and whether it has few rows."""
    rows = df.limit(FEW + 1).collect()
    return (df.sparkSession.createDataFrame(rows, df.schema), True) if len(rows) <= FEW else (written(df, "quantiles"), False)


def _closer(rows: DataFrame, ranks: DataFrame, few: bool) -> DataFrame:
    """ranks (g_, k, lo, hi, below) after a round: lo and hi of the bin that holds the rank, below the values under it."""
    width = F.col("hi") / 2 - F.col("lo") / 2
    part = F.try_divide(F.col("x_") / 2 - F.col("lo") / 2, width) * BINS
    number = F.when(width > 0, F.least(F.lit(BINS - 1), F.floor(part))).otherwise(F.when(F.col("x_") > F.col("lo"), 1).otherwise(0))
    ranks = ranks.withColumnRenamed("g_", "of_")
    met = rows.join(F.broadcast(ranks) if few else ranks, F.col("g_").eqNullSafe(F.col("of_")) & F.col("x_").between(F.col("lo"), F.col("hi")))
    bins = met.groupBy("of_", "k", "below", number.alias("bin")).agg(F.count("*").alias("c"), F.min("x_").alias("lo"), F.max("x_").alias("hi"))
    before = F.col("below") + F.coalesce(F.sum("c").over(Window.partitionBy("of_", "k").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = bins.withColumn("under", before).where((F.col("under") <= F.col("k")) & (F.col("k") < F.col("under") + F.col("c")))
    return found.select(F.col("of_").alias("g_"), "lo", "hi", "k", F.col("under").alias("below"))
