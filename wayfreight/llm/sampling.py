"""Bounded, repeatable samples of labelled rows for models that are fitted on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sample_by_class(rows: DataFrame, label: str, key: Column, per_class: int, most_classes: int = 500) -> tuple[DataFrame, dict]:
    """About ``per_class`` rows of each class, picked by a hash of ``key``, and the rows there are by class.

    Of a key that repeats within a class one row stays, which is settled map-side, so that no key
    takes the places of others. More classes than ``most_classes`` stop the job: then the label is not a class.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().limit(most_classes + 1).collect()}
    if len(counts) > most_classes:
        raise ValueError(f"{label} has more than {most_classes} values")
    if not counts:
        return rows.limit(0), counts
    share = F.pmod(F.xxhash64(key.cast("string"), F.lit("sample")), F.lit(1_000_000)) / 1_000_000
    wanted = F.lit(False)
    for value, n in counts.items():
        wanted = wanted | ((F.col(label) == F.lit(value)) & (share < min(1.0, per_class / n)))
    keyed = rows.filter(wanted).withColumn("__key", key)
    return keyed.dropDuplicates([label, "__key"]).drop("__key"), counts
