"""Whether two stores agree: ids, counts of pages, orphans, attributes; issues, a status, and their repair."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.operators.catalog import one_row

#: What to do about a kind of issue; fixed values.
ADVICE = {
    "missing_left": "Remove the vector or import the paper",
    "missing_right": "Compute the paper's vector",
    "page_count_mismatch": "Compute the paper's page vectors anew",
    "orphaned_record": "Delete the record",
    "attribute_mismatch": "Write the attribute anew",
    "count_mismatch": "Run a full check",
}
SEVERITY = {"missing_left": "medium", "missing_right": "medium", "page_count_mismatch": "medium", "orphaned_record": "high", "attribute_mismatch": "low", "count_mismatch": "high"}


def _issues(df: DataFrame, kind: str, key: Column) -> DataFrame:
    return df.select(F.lit(kind).alias("kind"), key.cast("string").alias("key"), F.lit(SEVERITY[kind]).alias("severity"), F.lit(ADVICE[kind]).alias("advice"))


def id_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Issues for keys that only one side has. Keys are made distinct before they meet."""
    a = left.select(key).where(F.col(key).isNotNull()).distinct().withColumn("l", F.lit(True))
    b = right.select(key).where(F.col(key).isNotNull()).distinct().withColumn("r", F.lit(True))
    both = a.join(b, key, "full_outer").where("l IS NULL OR r IS NULL")
    return _issues(both.where("l IS NULL"), "missing_left", F.col(key)).unionByName(_issues(both.where("r IS NULL"), "missing_right", F.col(key)))


def count_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Issues for keys of which the sides have different numbers of rows."""
    a, b = (df.groupBy(key).agg(F.count("*").alias(n)) for df, n in ((left, "nl"), (right, "nr")))
    both = a.join(b, key, "full_outer").where(F.coalesce("nl", F.lit(0)) != F.coalesce("nr", F.lit(0)))
    return _issues(both, "page_count_mismatch", F.col(key))


def orphaned(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    gone = child.select(key).distinct().join(parent.select(key), key, "left_anti")
    return _issues(gone, "orphaned_record", F.col(key))


def attribute_differences(left: DataFrame, right: DataFrame, key: str, attribute: str, sample: int = 10) -> DataFrame:
    """Issues for matched keys whose attribute differs, a null on one side included; the first ones by key, as a report of examples."""
    a, b = left.select(key, F.col(attribute).alias("al")), right.select(key, F.col(attribute).alias("ar"))
    return _issues(a.join(b, key).where(~F.col("al").eqNullSafe(F.col("ar"))).orderBy(key).limit(sample), "attribute_mismatch", F.col(key))


def total_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """One issue if the sides have different numbers of rows, from one pass over each."""
    n = one_row(left.agg(F.count("*").alias("nl")), right.agg(F.count("*").alias("nr"))).where("nl <> nr")
    return _issues(n, "count_mismatch", F.concat_ws("/", "nl", "nr"))


def everything(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def status(issues: DataFrame) -> DataFrame:
    """One row: issues in all and by severity, and what they amount to."""
    of = lambda s: F.count_if(F.col("severity") == s).alias(s)
    counts = issues.agg(F.count("*").alias("issues"), of("critical"), of("high"), of("medium"), of("low"))
    level = F.when(F.col("issues") == 0, "excellent").when(F.col("critical") > 0, "critical").when(F.col("high") > 0, "poor").when(F.col("issues") > 10, "fair").otherwise("good")
    return counts.withColumn("status", level)


def recommendations(issues: DataFrame) -> DataFrame:
    return issues.groupBy("kind", "advice").agg(F.count("*").alias("n"))


def quick_summary(left: DataFrame, right: DataFrame, checked: Column, issues: Column) -> DataFrame:
    """Whether counts match, and whether the last check found nothing."""
    n = one_row(left.agg(F.count("*").alias("papers")), right.agg(F.count("*").alias("vectors")))
    match = F.col("papers") == F.col("vectors")
    return n.withColumn("counts_match", match).withColumn("status", F.when(~checked, "never_checked").when(match & (issues == 0), "consistent").otherwise("inconsistent"))


def repaired(child: DataFrame, parent: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The child rows that stay once orphans go, and a row that counts what went."""
    kept = child.join(parent.select(key), key, "left_semi")
    gone = child.join(parent.select(key), key, "left_anti")
    return kept, gone.agg(F.count("*").alias("fixed"))


def corrected(stored: DataFrame, truth: DataFrame, key: str, attribute: str) -> tuple[DataFrame, DataFrame]:
    """stored with the attribute of matched keys set to the truth's, and a row that counts what was wrong. Keys that the truth lacks stay as they are."""
    known = truth.select(key, F.col(attribute).alias("true_"), F.lit(True).alias("known_"))
    wrong = F.coalesce("known_", F.lit(False)) & ~F.col(attribute).eqNullSafe(F.col("true_"))
    marked = stored.join(known, key, "left").withColumn("wrong_", wrong)
    fixed = marked.withColumn(attribute, F.when(F.col("wrong_"), F.col("true_")).otherwise(F.col(attribute)))
    return fixed.select(*stored.columns), marked.agg(F.count_if("wrong_").alias("fixed"))
