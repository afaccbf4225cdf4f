"""Reproducible samples (S2, O3, S12) without driver-side RNG.

Rows are ranked by the md5 of seed and key; the first ``n`` form
the sample.  A small n is a ``TakeOrderedAndProject``: each task keeps
its local n best and only n·tasks rows reach the final merge.  For a larger one the
hashes' first four digits are counted; the ranges that fit are kept whole, and only the
one range at the border is ranked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


TOP_ROWS = 100_000  # rows that one task may rank


def stable_sample(df: DataFrame, n: int | None, key: str, seed: int = 42) -> DataFrame:
    """Exactly ``min(n, rows)`` rows; all rows when n is None."""
    if n is None:
        return df
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    hashed = df.withColumn("_h", h)
    if n <= TOP_ROWS:
        return hashed.orderBy("_h", key).limit(n).drop("_h")
    digits = F.substring("_h", 1, 4)
    taken = 0
    for digit, rows in sorted(hashed.groupBy(digits.alias("d")).count().collect()):  # 65,536 rows at most
        if taken + rows > n:
            border = hashed.filter(digits == digit).orderBy("_h", key).limit(n - taken)
            return hashed.filter(digits < digit).unionByName(border).drop("_h")
        taken += rows
    return df


def sample_groups(df: DataFrame, group_col: str, n: int, seed: int = 42) -> DataFrame:
    """Keep every row of ``n`` seeded-hash-chosen groups (semi join back)."""
    groups = df.select(group_col).distinct()
    chosen = stable_sample(groups, n, key=group_col, seed=seed)
    return df.join(chosen, group_col, "left_semi")
