"""The message archive: newest version of a message, search, statistics, day partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions import text, times
from postmill.operators.fulltext import FIELDS, matches, parse_match, snippet, token_index  # noqa: F401
from postmill.session import exists


def newest(df: DataFrame, key: str = "id", order: tuple[str, ...] = ("fetched_at",), count: str | None = None) -> DataFrame:
    """Last write wins: one row for each key, ties by the whole row; ``count`` names a column for its number of rows.

    An aggregate with map-side combine; a key written over and over gathers no group.
    """
    rest = [c for c in df.columns if c != key and c not in order]
    found = df.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("_row"), F.count(F.lit(1)).alias("_n"))
    return found.select(key, "_row.*", *([F.col("_n").alias(count)] if count else [])).select(*df.columns, *([count] if count else []))


def archive_date() -> Column:
    """The date by which the archive is ordered: certified, else fetched."""
    return F.coalesce("date_certified", "fetched_at")


def search(df: DataFrame, *, client: str | None = None, account: str | None = None, sender: str | None = None, since: str | None = None, until: str | None = None, msg_type: str | None = None, limit: int | None = 50) -> DataFrame:
    """Messages that meet all filters; with a limit the newest first, ties by id, without one in no order.

    ``sender`` is a part of address or domain in any case and its % and _ are wildcards; ``client`` also
    meets the account. Over the newest versions the filters come after the aggregate that finds these.
    """
    d = archive_date()
    if client is not None:
        df = df.where((F.col("client") == client) | (F.col("account") == client))
    if account is not None:
        df = df.where(F.col("account") == account)
    if sender is not None:
        df = df.where(F.col("from_addr").ilike(f"%{sender}%") | F.col("from_domain").ilike(f"%{sender}%"))
    if since is not None:
        df = df.where(d >= since)
    if until is not None:
        df = df.where(times.until(d, until))
    if msg_type is not None:
        df = df.where(F.col("msg_type") == msg_type)
    return df.orderBy(d.desc_nulls_last(), F.col("id")).limit(limit) if limit is not None else df


def stats(df: DataFrame) -> DataFrame:
    """Number of messages by type with first and last archive date."""
    d = archive_date()
    return df.groupBy("msg_type").agg(F.count(F.lit(1)).alias("n"), F.min(d).alias("first_date"), F.max(d).alias("last_date"))


def with_day(df: DataFrame) -> DataFrame:
    """Adds ``giorno``, the day partition of the message's best date."""
    return df.withColumn("giorno", F.substring(times.best_date(F.col("date_certified"), F.col("date_sent"), F.col("fetched_at")), 1, 10))


def last_days(df: DataFrame, n: int, day: str = "giorno") -> DataFrame:
    """Rows of the last n days that exist (not calendar days); the list of days is small and broadcast."""
    days = df.select(day).where(F.col(day).isNotNull()).distinct().orderBy(F.col(day).desc()).limit(n)
    return df.join(F.broadcast(days), day, "left_semi")


def write_index(df: DataFrame, path: str, mode: str = "append") -> None:
    """One JSON line for each message under its day."""
    with_day(df).repartition("giorno").write.partitionBy("giorno").mode(mode).json(path)


def index_record() -> list[Column]:
    """The compact record of a message as nested columns."""
    return [
        F.col("id"), F.col("fetched_at").alias("acquisito_il"), F.struct(F.col("account").alias("id"), F.col("mailbox_label").alias("etichetta"), F.col("mailbox_address").alias("indirizzo"), F.col("client").alias("cliente")).alias("casella"),
        F.col("msg_type").alias("tipo"), (F.col("certified") == 1).alias("certificato"), F.struct(F.col("date_certified").alias("certificata"), F.col("date_sent").alias("invio"), F.col("fetched_at").alias("ricezione")).alias("data"),
        F.struct(F.lower("from_addr").alias("indirizzo"), F.col("from_name").alias("nome"), text.domain(F.col("from_addr")).alias("dominio")).alias("mittente"), F.col("subject").alias("oggetto"), F.col("message_id"),
        F.when(F.col("receipt_kind").isNotNull(), F.struct(F.col("receipt_kind").alias("tipo"), F.col("receipt_class").alias("classe"), F.col("ref_message_id").alias("riferimento_message_id"))).alias("ricevuta"),
    ]


def full_metadata() -> list[Column]:
    """The compact record with everything else that is known of a message."""
    more = ["certified", "receipt_kind", "pec_identifier", "gestore", "content_dir", "index_file", "n_attachments", "body_chars"]
    recipients = F.filter(F.transform(F.split(F.coalesce("to_addrs", F.lit("")), ","), lambda a: F.lower(F.trim(a))), lambda a: a != "")
    return [*index_record(), recipients.alias("destinatari"), F.struct(*more).alias("dettagli")]


def lowered(df: DataFrame, columns: tuple[str, ...] = ("mailbox_address", "from_addr", "from_domain", "to_addrs")) -> DataFrame:
    """Migration of older archives: addresses in lower case, as they are compared."""
    return df.withColumns({c: F.lower(c) for c in columns})


def upsert(df: DataFrame, path: str, key: str = "id", buckets: int = 64) -> None:
    """Add versions of messages to the archive; what it holds already, key and time of fetching, is left out.

    The newest version wins when read (``newest``), so that an upsert appends and never rewrites.
    """
    spark = df.sparkSession
    rows = df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).dropDuplicates(["bucket", key, "fetched_at"])
    if exists(spark, path):
        rows = rows.join(spark.read.schema(rows.schema).parquet(path).select("bucket", key, "fetched_at"), ["bucket", key, "fetched_at"], "left_anti")
    rows.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(path)


def add_missing(df: DataFrame, path: str, key: str, buckets: int = 64) -> None:
    """Append the rows of keys that the table does not hold."""
    rows = df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    if exists(df.sparkSession, path):
        rows = rows.join(df.sparkSession.read.schema(rows.schema).parquet(path).select("bucket", key).distinct(), ["bucket", key], "left_anti")
    rows.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(path)


def searched(hits: DataFrame, link: DataFrame, df: DataFrame, **filters) -> DataFrame:
    """Messages among the full-text hits (rowid_fts) that meet the filters of ``search``."""
    ids = link.join(hits, "rowid_fts", "left_semi").select(F.col("msg_id").alias("id")).distinct()
    return search(df.join(ids, "id", "left_semi"), **filters)
