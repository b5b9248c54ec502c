"""Incremental ingestion: what is new, what is a twin, what fits the budget, where to go on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A message in one of these states is not looked at again. Fixed values.
CONCLUDED = ("done", "skipped", "duplicate")
#: States of a copy that was written or skipped. Fixed values.
WORKED = ("done", "skipped")
KEY = ("account", "uidvalidity", "uid")
# Receipt types by whether the delivery went well.
POSITIVE = ("accettazione", "presa_in_carico", "avvenuta_consegna")
NEGATIVE = ("non_accettazione", "errore_consegna", "preavviso_errore_consegna", "rilevazione_virus")
#: Transport header values to message types. Fixed values.
RECEIPTS = {
    "accettazione": "accettazione", "non-accettazione": "non_accettazione", "presa-in-carico": "presa_in_carico", "avvenuta-consegna": "avvenuta_consegna", "preavviso-errore-consegna": "preavviso_errore_consegna",
    "errore-consegna": "errore_consegna", "mancata-consegna": "errore_consegna", "rilevazione-virus": "rilevazione_virus", "errore-consegna-virus": "rilevazione_virus",
}


def content_hash(raw: Column) -> Column:
    """SHA-256 of a message's bytes, hexadecimal."""
    return F.sha2(raw, 256)


def message_key(account: Column, digest: Column) -> Column:
    """Identity within a mailbox: 24 hexadecimal digits over account, a zero byte and the content hash."""
    return F.substring(F.sha2(F.concat(account.cast("binary"), F.unhex(F.lit("00")), digest.cast("binary")), 256), 1, 24)


def pending(incoming: DataFrame, state: DataFrame) -> DataFrame:
    """Incoming rows that the state does not hold as concluded (left anti join on the key)."""
    return incoming.join(state.where(F.col("status").isin(*CONCLUDED)).select(*KEY), list(KEY), "left_anti")


def twins(df: DataFrame) -> DataFrame:
    """Adds ``first_uidvalidity``, ``first_uid`` and ``duplicate``: the first worked row of the same content of a mailbox.

    Only a copy that was written or skipped makes another one a duplicate: one that failed must not hide it.
    The first row is an aggregate with map-side combine, so a content that fills a third of the table
    gathers one row and not its group; rows without a hash are no twins.
    """
    first = df.where(F.col("content_hash").isNotNull() & F.col("status").isin(*WORKED)).groupBy("account", "content_hash").agg(F.min(F.struct("uidvalidity", "uid")).alias("_first"))
    joined = df.join(first, ["account", "content_hash"], "left")
    return joined.withColumns({"first_uidvalidity": F.col("_first.uidvalidity"), "first_uid": F.col("_first.uid"), "duplicate": F.coalesce(F.col("_first") != F.struct("uidvalidity", "uid"), F.lit(False))}).drop("_first")


def budget(df: DataFrame, limit: int, order: tuple[str, ...] = ("uidvalidity", "uid")) -> DataFrame:
    """At most ``limit`` rows of each account in order of arrival.

    The rank filter is applied in each task before the shuffle (window group limit), so no account
    moves more than ``limit`` rows a task.
    """
    w = Window.partitionBy("account").orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= limit).drop("_rank")


def remaining(df: DataFrame, limit: int) -> DataFrame:
    """How many rows of each account the budget leaves for the next run."""
    return df.groupBy("account").agg(F.greatest(F.count(F.lit(1)) - limit, F.lit(0)).alias("remaining"))


def cursors(df: DataFrame) -> DataFrame:
    """The highest uid of each account and epoch."""
    return df.groupBy("account", "uidvalidity").agg(F.max("uid").alias("last_uid"), F.count(F.lit(1)).alias("n"))


def beyond(incoming: DataFrame, cursor: DataFrame) -> DataFrame:
    """Rows after the mailbox's cursor; where the epoch changed, or there is no cursor, all of them."""
    c = cursor.select("account", F.col("uidvalidity").alias("_epoch"), F.col("last_uid").alias("_last"))
    joined = incoming.join(c, "account", "left")
    return joined.where(F.col("_epoch").isNull() | (F.col("_epoch") != F.col("uidvalidity")) | (F.col("uid") > F.coalesce("_last", F.lit(0)))).drop("_epoch", "_last")


def receipt_class(kind: Column) -> Column:
    """positiva, negativa or null."""
    return F.when(kind.isin(*POSITIVE), "positiva").when(kind.isin(*NEGATIVE), "negativa")


def first_receipts(df: DataFrame, count: str | None = None) -> DataFrame:
    """One row for each message: the earliest recorded, ties by the remaining columns; ``count`` names a column for its rows."""
    rest = [c for c in df.columns if c not in ("msg_id", "recorded_at")]
    found = df.groupBy("msg_id").agg(F.min(F.struct("recorded_at", *rest)).alias("_r"), F.count(F.lit(1)).alias("_n"))
    return found.select("msg_id", "_r.*", *([F.col("_n").alias(count)] if count else []))


def split_receipts(df: DataFrame, kind: str = "msg_type") -> tuple[DataFrame, DataFrame]:
    """(messages, receipts): positive receipts go to the registry, everything else to the archive."""
    positive = F.coalesce(F.col(kind).isin(*POSITIVE), F.lit(False))
    return df.where(~positive), df.where(positive)


def certified(kind: Column) -> Column:
    """Whether a message came with a provider's certificate; receipts did."""
    return ~F.coalesce(kind, F.lit("generico")).isin("busta_anomalia", "generico")


def selected_accounts(accounts: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """Enabled accounts, or the named ones of them; a name that no account has is an error (a bounded check on the driver)."""
    if wanted:
        missing = sorted(set(wanted) - {r.account for r in accounts.where(F.col("account").isin(*wanted)).select("account").distinct().collect()})
        if missing:
            raise ValueError(f"unknown accounts: {', '.join(missing)}")
        accounts = accounts.where(F.col("account").isin(*wanted))
    return accounts.where(F.coalesce("enabled", F.lit(True))) if "enabled" in accounts.columns else accounts


def since_day(df: DataFrame, day: str, at: str = "internaldate") -> DataFrame:
    """Rows of a day or later, by whole days; rows without a date are left out."""
    return df.where(F.to_date(at) >= F.to_date(F.lit(day)))


def start_positions(df: DataFrame, lookback_day: str | None = None) -> DataFrame:
    """Where each mailbox epoch starts without reading: before the first row since a day, else after the last row."""
    last = F.coalesce(F.max("uid"), F.lit(0))
    if lookback_day is not None:
        last = F.coalesce(F.min(F.when(F.to_date("internaldate") >= F.to_date(F.lit(lookback_day)), F.col("uid"))) - 1, last)
    return df.groupBy("account", "uidvalidity").agg(F.greatest(last, F.lit(0)).alias("last_uid"))


#: attempts after which a message is written without extraction. Fixed value.
ATTEMPTS = 3


def degraded(attempts: Column) -> Column:
    """Whether a message failed so often that its attachments are no longer read."""
    return F.coalesce(attempts, F.lit(0)) > ATTEMPTS


def classify(declared: Column, receipt: Column, transport: Column, subject: Column) -> Column:
    """Message type from certified metadata, then receipt and transport headers, then the subject's opening."""
    table = F.create_map(*[F.lit(x) for kv in RECEIPTS.items() for x in kv])
    d, r, t, s = (F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in (declared, receipt, transport, subject))
    # How subjects of the types begin
    openings = (
        ("anomalia messaggio", "busta_anomalia"), ("accettazione:", "accettazione"), ("consegna:", "avvenuta_consegna"), ("avviso di mancata consegna", "errore_consegna"),
        ("avviso di non accettazione", "non_accettazione"), ("preavviso di mancata consegna", "preavviso_errore_consegna"), ("problema di sicurezza", "rilevazione_virus"),
    )
    out = F.coalesce(
        F.element_at(table, d), F.when(d == "posta-certificata", "posta_certificata").when(d == "busta-anomalia", "busta_anomalia"),
        F.element_at(table, r), F.when(t == "posta-certificata", "posta_certificata").when(t == "errore", "busta_anomalia"),
    )
    for opening, kind in openings:
        out = F.coalesce(out, F.when(s.startswith(opening), F.lit(kind)))
    return F.coalesce(out, F.lit("generico"))


def reconcile(state: DataFrame, sink: DataFrame) -> DataFrame:
    """State merged with what the sink proves: id, status (``done`` where the sink has it), known, proven."""
    s = state.select("id", "status", F.lit(True).alias("known"))
    p = sink.select("id").distinct().withColumn("proven", F.lit(True))
    full = s.join(p, "id", "full_outer")
    return full.select("id", F.when(F.col("proven"), "done").otherwise(F.col("status")).alias("status"), F.coalesce("known", F.lit(False)).alias("known"), F.coalesce("proven", F.lit(False)).alias("proven"))
