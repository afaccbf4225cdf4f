"""Column profiles that merge.

A state is a row of sums and sketches for each column and part of a table (a day, a
batch): rows, nulls, least, greatest, sum and sum of squares are exact; distinct values
are a HyperLogLog sketch of 2^`LOG_K` registers (a standard error of 1.04 / 2^(`LOG_K` / 2),
1.6 %), quantiles a KLL sketch of size `KLL_K` (a rank error of 1.33 % at 99 %
confidence for one quantile).  States of parts add up to the state of the whole without
reading old rows again, in any order and grouping.  Frequent values have a state of their
own, a row a value, with bounds of their counts that hold after any merge.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG_K = 12
KLL_K = 200
EXACT = {"n": F.sum, "n_null": F.sum, "low": F.min, "high": F.max, "total": F.sum, "squares": F.sum}


def profile_state(df: DataFrame, columns: Sequence[str], part: Sequence[str] = ()) -> DataFrame:
    """(part..., column, n, n_null, low, high, total, squares, kinds, ranks): one row a
    column and part, from one pass.  Numbers only have what needs numbers."""
    aggs, structs = [], []
    for i, c in enumerate(columns):
        v = F.col(f"`{c}`")
        number = isinstance(df.schema[c].dataType, T.NumericType)
        x = v.cast("double") if number else F.lit(None).cast("double")
        made = {"n": F.count(F.lit(1)), "n_null": F.count_if(v.isNull()), "low": F.min(x), "high": F.max(x),
                "total": F.sum(x), "squares": F.sum(x * x), "kinds": F.hll_sketch_agg(v.cast("string"), F.lit(LOG_K)),
                "ranks": F.kll_sketch_agg_double(x, KLL_K) if number else F.first(F.lit(None).cast("binary"))}
        aggs += [a.alias(f"_{i}_{name}") for name, a in made.items()]
        structs.append(F.struct(F.lit(c).alias("column"), *[F.col(f"_{i}_{name}").alias(name) for name in made]))
    return df.groupBy(*part).agg(*aggs).select(*part, F.inline(F.array(*structs)))


def merge_states(states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """States of many parts as one state a column, and for each value of ``by``."""
    return states.groupBy(*by, "column").agg(
        *[f(c).alias(c) for c, f in EXACT.items()], F.hll_union_agg("kinds").alias("kinds"),
        F.kll_merge_agg_double("ranks").alias("ranks"))


def read_profile(state: DataFrame, quantiles: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """The profile that a state describes, a column a row."""
    held = F.col("n") - F.col("n_null")
    mean = F.col("total") / F.when(held > 0, held)
    spread = F.when(mean.isNotNull(), F.sqrt(F.greatest(F.col("squares") / held - mean * mean, F.lit(0.0))))
    number = F.col("low").isNotNull()
    at = [F.when(number, F.kll_sketch_get_quantile_double("ranks", F.lit(float(q)))).alias(f"q{round(100 * q)}") for q in quantiles]
    keep = [c for c in state.columns if c not in (*EXACT, "kinds", "ranks")]
    return state.select(*keep, F.col("n").alias("n_rows"), "n_null", F.hll_sketch_estimate("kinds").alias("n_distinct"),
                        F.col("low").alias("min"), F.col("high").alias("max"), mean.alias("mean"), spread.alias("std"), *at)


# Heavy hitters -------------------------------------------------------------------------
def frequent_state(df: DataFrame, columns: Sequence[str], part: Sequence[str] = (), keep: int = 100) -> DataFrame:
    """(part..., column, value, low, high, missed): the ``keep`` most frequent values, as
    text, of each column and part.  ``low`` and ``high`` bound a value's count, and no value
    that is not listed has more than ``missed`` rows, at most one in ``keep`` + 1 of the part's.
    Equal counts go to the smaller value; nulls are not counted."""
    each = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns]))
    counts = (df.select(*part, each).filter("value IS NOT NULL").groupBy(*part, "column", "value")
              .agg(F.count(F.lit(1)).alias("low")))
    return _most_frequent(counts.withColumns({"high": F.col("low"), "missed": F.lit(0).cast("long")}), [*part, "column"], keep)


def merge_frequent(states: DataFrame, part: Sequence[str], by: Sequence[str] = (), keep: int = 100) -> DataFrame:
    """States of many parts as one for each value of ``by``, of the same form: a part that does not
    list a value may hold it as often as its ``missed`` says."""
    group = [*by, "column"]
    missed = (states.groupBy(*dict.fromkeys([*group, *part])).agg(F.max("missed").alias("missed"))
              .groupBy(*group).agg(F.sum("missed").alias("missed")))
    values = states.groupBy(*group, "value").agg(F.sum("low").alias("low"), F.sum(F.col("high") - F.col("missed")).alias("above"))
    merged = values.join(missed, group).select(*group, "value", "low", (F.col("above") + F.col("missed")).alias("high"), "missed")
    return _most_frequent(merged, group, keep)


def _most_frequent(values: DataFrame, group: Sequence[str], keep: int) -> DataFrame:
    """The ``keep`` rows of highest count in each group; tasks drop the others before the
    shuffle, and the first row that is dropped bounds the rest."""
    ranked = Window.partitionBy(*group).orderBy(F.col("high").desc(), "value")
    some = values.withColumn("_r", F.row_number().over(ranked)).filter(F.col("_r") <= keep + 1)
    dropped = F.max(F.when(F.col("_r") > keep, F.col("high"))).over(Window.partitionBy(*group))
    return (some.withColumn("missed", F.greatest("missed", F.coalesce(dropped, F.lit(0).cast("long"))))
            .filter(F.col("_r") <= keep).drop("_r"))
