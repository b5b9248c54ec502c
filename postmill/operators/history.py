"""How often a sender wrote before: strictly-before counts without one task for a busy sender."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def prior_counts(df: DataFrame, keys: list[str], at: str, name: str, day_chars: int = 10) -> DataFrame:
    """Adds ``name``: rows of the same keys with a strictly smaller ``at`` (an ISO string).

    Whole earlier days are summed from daily counts, only the rows of one day are ranked against each
    other. A sender with a third of all rows is so spread over its days.
    """
    day = F.substring(at, 1, day_chars)
    daily = df.groupBy(*keys, day.alias("_day")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    daily = daily.select(*keys, "_day", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = df.withColumn("_day", day).withColumn("_rank", F.rank().over(Window.partitionBy(*keys, "_day").orderBy(at)) - 1)
    return ranked.join(daily, [*keys, "_day"]).withColumn(name, (F.col("_before") + F.col("_rank")).cast("long")).drop("_day", "_rank", "_before")


def coverage(df: DataFrame, at: str, least_messages: int = 20, least_days: int = 90) -> DataFrame:
    """Messages, first and last date, whole days between (offsets ignored) and sufficiency of each account."""
    local = lambda c: F.unix_timestamp(F.try_to_timestamp(F.substring(c, 1, 19)))
    out = df.groupBy("account").agg(F.count(at).alias("total"), F.min(at).alias("first_date"), F.max(at).alias("last_date"))
    days = F.greatest(F.coalesce(F.floor((local("last_date") - local("first_date")) / 86400), F.lit(0)), F.lit(0)).cast("long")
    return out.withColumn("days", days).withColumn("sufficient", (F.col("total") >= least_messages) & (F.col("days") >= least_days))
