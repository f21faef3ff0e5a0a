"""What the classifiers share: which rows may be learned from, and a bounded sample of them."""

from __future__ import annotations

from collections import defaultdict
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """Rows whose crc32 of the id as text leaves 1 modulo 3 are never learned from; a null id isn't held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1, F.lit(False))


def chance(doc_id: Column) -> Column:
    """A number from 0 to 1 that depends on the id only."""
    return F.pmod(F.xxhash64(F.lit(11), doc_id), F.lit(1 << 40)).cast("double") / float(1 << 40)


def thin(rows: DataFrame, label: str, most: dict[Any, int]) -> DataFrame:
    """rows (doc_id, label, ...) thinned by a hash of the id to somewhat over most[label] rows of each label, if there are more."""
    counts = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count("*").alias("n")).collect() if r[label] in most}
    if not counts:
        return rows.limit(0)
    rates = F.create_map(*[F.lit(x) for value, n in counts.items() for x in (value, min(1.0, 1.15 * most[value] / n + 20 / n))])
    return rows.where(chance(F.col("doc_id")) < F.coalesce(F.try_element_at(rates, F.col(label)), F.lit(0.0)))


def cut(rows: list[Row], label: str, most: dict[Any, int]) -> list[Row]:
    """At most most[label] rows of each label, in the order of the sample's hash column `chance`."""
    groups: dict[Any, list[Row]] = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["chance"], r["doc_id"] is None, r["doc_id"])):
        if len(groups[r[label]]) < most[r[label]]:
            groups[r[label]].append(r)
    return [r for k in sorted(groups, key=str) for r in groups[k]]
