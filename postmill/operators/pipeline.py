"""From raw mail to the archive in one plan: identity, twins, parsing, classification, texts, sinks, state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions import extract, mime, times
from postmill.operators import archive, ingest
from postmill.streaming.ingest import identified

#: Fixed value: how much of a text the search index keeps.
INDEXED = 200_000


def parsed(raw: DataFrame) -> DataFrame:
    """Messages (account, uidvalidity, uid, internaldate, raw and, where known, attempts) with all that their bytes say.

    A message that cannot be parsed is a row with flags. The bytes are dropped once they are read.
    """
    m = mime.parse_messages(identified(raw)).drop("raw")
    p, c = F.col("parsed"), F.col("parsed.certificate")
    kind = ingest.classify(p["declared"], p["receipt"], p["transport"], p["envelope_subject"])
    sent = F.timestamp_seconds(p["sent_at"])
    best = F.coalesce(times.certificate_date(c["giorno"], c["ora"], c["zona"]), sent, F.col("internaldate").cast("timestamp"))
    said = F.when(c["errore_esteso"] != "", c["errore_esteso"]).when(~c["errore"].isin("", "nessuno"), c["errore"])
    return m.select(
        "account", "uidvalidity", "uid", "content_hash", "id", kind.alias("msg_type"), ingest.certified(kind).alias("certified"), ingest.receipt_class(kind).alias("receipt_class"),
        F.when(ingest.receipt_class(kind).isNotNull(), p["ref_message_id"]).alias("ref_message_id"), times.iso(best).alias("date_certified"), times.iso(sent).alias("date_sent"), F.lower(p["from"]["address"]).alias("from_addr"),
        p["from"]["name"].alias("from_name"), p["from"]["domain"].alias("from_domain"), F.array_join(F.transform(p["to"], lambda a: a["address"]), ", ").alias("to_addrs"), p["subject"].alias("subject"), p["message_id"].alias("message_id"),
        F.coalesce(c["identificativo"], F.lit("")).alias("pec_identifier"), F.coalesce(c["gestore"], F.lit("")).alias("gestore"), p["body"].alias("body"), p["body_source"].alias("body_source"), F.size(p["attachments"]).alias("n_attachments"),
        F.length(p["body"]).alias("body_chars"), p["attachments"].alias("attachments"), said.alias("error_detail"), p["flags"].alias("flags"), ingest.degraded(F.col("attempts") if "attempts" in raw.columns else F.lit(0)).alias("degraded"),
    )


def texts_of(messages: DataFrame, limits: extract.Limits = extract.Limits()) -> DataFrame:
    """One row for each attachment with its text; of a message that failed too often nothing is read."""
    rows = messages.select("id", "degraded", F.posexplode("attachments").alias("at", "a"))
    rows = rows.select("id", "at", F.col("a.name").alias("name"), F.col("a.content_type").alias("content_type"), F.col("a.size").alias("size"), F.when(~F.col("degraded"), F.col("a.payload")).alias("payload"), "degraded")
    read = extract.extract(rows.where(~F.col("degraded")).drop("degraded"), limits=limits)
    skipped = rows.where("degraded").select("id", "at", "name", "content_type", "size", F.lit("").alias("text"), F.lit("none").alias("method"), F.lit("disabled").alias("status"), F.lit(False).alias("truncated"), F.lit(0).alias("chars"))
    return read.unionByName(skipped)


def new_messages(raw: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(to write, twins): messages that the state has not concluded; twins repeat a content that was written, or an earlier one of the batch."""
    incoming = ingest.pending(identified(raw), state)
    worked = state.where(F.col("status").isin(*ingest.WORKED)).select("account", "content_hash").distinct().withColumn("_seen", F.lit(True))
    first = incoming.groupBy("account", "content_hash").agg(F.min(F.struct("uidvalidity", "uid")).alias("_first"))
    judged = incoming.join(first, ["account", "content_hash"]).join(worked, ["account", "content_hash"], "left")
    twin = F.coalesce(F.col("_seen"), F.lit(False)) | (F.col("_first") != F.struct("uidvalidity", "uid"))
    return judged.where(~twin).select(*raw.columns), judged.where(twin).select("account", "uidvalidity", "uid", "content_hash", "id")


def tables(messages: DataFrame, texts: DataFrame, fetched_at: Column) -> dict[str, DataFrame]:
    """The archive's tables from parsed messages: messages, messages_fts (by id), attachments, receipts.

    Positive receipts are registered only; everything else is archived.
    """
    kept, positive = ingest.split_receipts(messages)
    shared = texts.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "name", "text"))).alias("t"))
    names, bodies = F.array_join(F.transform("t", lambda x: x["name"]), " "), F.array_join(F.filter(F.transform("t", lambda x: x["text"]), lambda x: x != ""), "\n")
    fts = kept.join(shared, "id", "left").select(
        "id", "subject", F.trim(F.concat_ws(" ", "from_name", "from_addr")).alias("sender"), F.col("to_addrs").alias("recipients"), F.substring("body", 1, INDEXED).alias("body"),
        F.substring(F.coalesce(F.concat(names, F.lit("\n"), bodies), F.lit("\n")), 1, INDEXED).alias("attachments"),
    )
    rows = kept.select("id", "account", "msg_type", F.col("certified").cast("int").alias("certified"), "receipt_class", "ref_message_id", "date_certified", "date_sent", fetched_at.alias("fetched_at"), "from_addr", "from_name", "from_domain", "to_addrs", "subject", "message_id", "pec_identifier", "gestore", "n_attachments", "body_chars")
    registry = positive.select(F.col("id").alias("msg_id"), "account", F.col("msg_type").alias("kind"), "ref_message_id", "subject", "gestore", "date_certified", fetched_at.alias("recorded_at"))
    return {"messages": rows, "messages_fts": fts, "attachments": texts.join(kept.select("id"), "id", "left_semi").select(F.col("id").alias("msg_id"), "name", "content_type", "size", "method", "status", "chars"), "receipts": ingest.first_receipts(registry)}


def phases(held: DataFrame, keys: DataFrame) -> DataFrame:
    """(key columns, files_done, index_done, archive_done, next): where an interrupted message is taken up again."""
    done = [F.coalesce(F.col(f"{p}_done") == 1, F.lit(False)) for p in ("files", "index", "archive")]
    following = F.when(~done[0], "files").when(~done[1], "index").when(~done[2], "archive").otherwise("done")
    return keys.join(held, list(ingest.KEY), "left").select(*ingest.KEY, *[d.alias(f"{p}_done") for d, p in zip(done, ("files", "index", "archive"), strict=True)], following.alias("next"))


def run(raw: DataFrame, state: DataFrame, path: str, fetched_at: Column, limits: extract.Limits = extract.Limits(), buckets: int = 64) -> DataFrame:
    """Write what is new to ``path``/table and give the state rows of the batch; a replay adds nothing.

    The tables are written before the state is given, so that an interrupted run is done again and not lost.
    """
    from postmill.session import stored

    fresh, twins = new_messages(raw, state)
    messages = stored(parsed(fresh))
    out = tables(messages, texts_of(messages, limits), fetched_at)
    archive.upsert(out["messages"], f"{path}/messages", buckets=buckets)
    for name, key in (("messages_fts", "id"), ("attachments", "msg_id"), ("receipts", "msg_id")):
        archive.add_missing(out[name], f"{path}/{name}", key, buckets)
    done = messages.select(*ingest.KEY, F.col("id").alias("msg_id"), "content_hash", "msg_type", F.when(F.col("msg_type").isin(*ingest.POSITIVE), "skipped").otherwise("done").alias("status"))
    same = twins.select(*ingest.KEY, F.col("id").alias("msg_id"), "content_hash", F.lit(None).cast("string").alias("msg_type"), F.lit("duplicate").alias("status"))
    return done.unionByName(same)
