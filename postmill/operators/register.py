"""The correction register: how many results of each kind were corrected, over several keys at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def register(outcomes: DataFrame, corrected: DataFrame, keys: list[str], key: str = "id") -> DataFrame:
    """(dimension, value, total, corrected, rate) for each value of each key, and dimension ``tutti``.

    One pass with grouping sets; a null or empty value is the dash. ``rate`` is corrected over total to
    three digits, half to even. Corrections are joined once as distinct keys.
    """
    flagged = outcomes.join(corrected.select(key).distinct().withColumn("_c", F.lit(1)), key, "left")
    cleaned = flagged.select(F.coalesce("_c", F.lit(0)).alias("_c"), *[F.coalesce(F.when(F.col(k).cast("string") != "", F.col(k).cast("string")), F.lit("—")).alias(k) for k in keys])
    sets = cleaned.groupingSets([[F.col(k)] for k in keys] + [[]], *[F.col(k) for k in keys])
    out = sets.agg(F.count(F.lit(1)).alias("total"), F.sum("_c").alias("corrected"), *[F.grouping(k).alias(f"_g_{k}") for k in keys])
    dimension, value = F.lit("tutti"), F.lit("")
    for k in reversed(keys):
        dimension = F.when(F.col(f"_g_{k}") == 0, F.lit(k)).otherwise(dimension)
        value = F.when(F.col(f"_g_{k}") == 0, F.col(k)).otherwise(value)
    rate = F.when(F.col("total") > 0, F.bround(F.col("corrected") / F.col("total"), 3)).otherwise(F.lit(0.0))
    return out.select(dimension.alias("dimension"), value.alias("value"), "total", F.coalesce("corrected", F.lit(0)).alias("corrected"), rate.alias("rate"))
