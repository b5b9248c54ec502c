"""Queries of the text operators and their SQL; the entry point adds them only where this imports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm import mojibake, names, packing, pii, quotes, scans, tokenize
from postmill.session import checkpoint, spread
from postmill.sources.tables import read_table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every mention of personal information in subjects, bodies and attachment texts."""
    fts = spread(read_table(spark, sf_dir, "messages_fts").select("rowid_fts", "body", "attachments"))
    inside = pii.find(fts, "rowid_fts", {"body": "body", "attachments": "attachments"})
    inside = inside.join(read_table(spark, sf_dir, "fts_map").select(F.col("msg_id").alias("id"), "rowid_fts"), "rowid_fts")
    subjects = spread(read_table(spark, sf_dir, "messages").select("id", "subject")).distinct()
    columns = ["id", "field", "kind", "start_pos", "end_pos"]
    return inside.select(*columns).union(pii.find(subjects, "id", {"subject": "subject"}).select(*columns).distinct())


def p1_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects, bodies and attachment texts with typed placeholders; a text without a link in fts_map has a null id."""
    fts = spread(read_table(spark, sf_dir, "messages_fts").select("rowid_fts", "body", "attachments"))
    inside = pii.redact(fts, "rowid_fts", {"body": "body", "attachments": "attachments"})
    inside = inside.join(read_table(spark, sf_dir, "fts_map").select(F.col("msg_id").alias("id"), "rowid_fts"), "rowid_fts", "left")
    subjects = spread(read_table(spark, sf_dir, "messages").select("id", "subject")).distinct()
    columns = ["id", "field", "text", "rowid_fts"]
    subjects = pii.redact(subjects, "id", {"subject": "subject"}).withColumn("rowid_fts", F.lit(None).cast("bigint"))
    return inside.select(*columns).union(subjects.select(*columns))


def _mail(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    date = F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in ("date_certified", "date_sent", "fetched_at")])
    at = F.coalesce(F.date_format(F.try_to_timestamp(date), "yyyy-MM-dd HH:mm:ss"), date)
    dates = read_table(spark, sf_dir, "messages").groupBy(F.col("id").alias("msg_id")).agg(F.min(at).alias("at"))
    linked = read_table(spark, sf_dir, "fts_map").join(dates, "msg_id").groupBy("rowid_fts").agg(F.min("at").alias("at"))
    fts = read_table(spark, sf_dir, "messages_fts").select("rowid_fts", "subject", "sender", "body")
    return spread(fts), linked


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every body that its sender newly wrote."""
    fts, dates = _mail(spark, sf_dir)
    return quotes.own_lines(fts, dates=dates)


def p2_reduced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every body as the text that its sender newly wrote, empty where nothing is new."""
    fts, dates = _mail(spark, sf_dir)
    return quotes.new_text(fts, dates=dates)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of typed names that mean the same person or organisation."""
    return names.variants(read_table(spark, sf_dir, "messages").select("from_name", "client", "from_addr"))


def p3_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every typed name and the one that stands for all its spellings."""
    return names.members(read_table(spark, sf_dir, "messages").select("from_name", "client", "from_addr"))


_SCAN_COLUMNS = ("extraction_id", "text", "is_ocr", "method", "pages")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page furniture, cut words and misread characters by line of every scanned text."""
    return scans.found(spread(read_table(spark, sf_dir, "extractions").select(*_SCAN_COLUMNS)))


def p5_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every extracted text, the scanned ones as continuous paragraphs."""
    return scans.repair(spread(read_table(spark, sf_dir, "extractions").select(*_SCAN_COLUMNS)))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, without special tokens."""
    return tokenize.encode(spread(read_table(spark, sf_dir, "documents").select("doc_id", "text")))


def p7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bin in every kind of container."""
    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return packing.pack(tokenize.token_counts(docs), read_table(spark, sf_dir, "containers"))


def p6_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents have no token, and whether each has no more of them than bytes."""
    ids = p6_ids(spark, sf_dir).select("doc_id", F.size("ids").alias("n"))
    size = F.coalesce(F.octet_length(F.encode("text", "utf-8")), F.lit(0))
    return read_table(spark, sf_dir, "documents").select("doc_id", size.alias("bytes")).join(ids, "doc_id").select("doc_id", (F.col("n") == 0).alias("empty"), (F.col("n") <= F.col("bytes")).alias("fits"))


def p7_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a packing must hold, by kind of container: no bin over capacity, no document lost, cut needlessly or in wrong places."""
    docs = checkpoint(tokenize.token_counts(spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))))
    kinds = read_table(spark, sf_dir, "containers").select("container_id", "capacity")
    packed = checkpoint(packing.pack(docs, kinds))
    over = packed.where(F.col("bin_id").isNotNull()).groupBy("container_id", "bin_id").agg(F.sum("n").alias("n")).join(kinds, "container_id").groupBy("container_id").agg(F.count_if(F.col("n") > F.col("capacity")).alias("over"))
    whole = packed.groupBy("container_id", "doc_id").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("pieces"), F.max(F.col("start") + F.col("n")).alias("last")).join(docs, "doc_id").join(kinds, "container_id")
    size = F.coalesce("n_tokens", F.lit(0))
    wrong = (F.col("n") != size) | (F.col("last") != size) | (F.col("pieces") != F.greatest(F.ceil(size / F.col("capacity")), F.lit(1)))
    return whole.groupBy("container_id").agg(F.count(F.lit(1)).alias("documents"), F.count_if(wrong).alias("wrong")).join(over, "container_id").select("container_id", "documents", "wrong", "over")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of which some text was read with the wrong encoding."""
    return p8_restored(spark, sf_dir).select("doc_id").distinct()


def p8_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The affected documents and their text as far as it can be restored."""
    return mojibake.repair(spread(read_table(spark, sf_dir, "documents").select("doc_id", "text")))


QUERIES = {
    "p5_found": p5_found, "p5_repaired": p5_repaired, "p1_found": p1_found, "p1_redacted": p1_redacted, "p2_found": p2_found, "p2_reduced": p2_reduced, "p3_found": p3_found, "p3_entities": p3_entities, "p6_ids": p6_ids, "p6_empty": p6_empty,
    "p7_pack": p7_pack, "p7_checked": p7_checked, "p8_found": p8_found, "p8_restored": p8_restored,
}
ORACLE: dict[str, str] = {
    "p6_empty": "SELECT doc_id, coalesce(text, '') = '' AS empty, true AS fits FROM documents",
    "p7_checked": "SELECT container_id, (SELECT count(*) FROM documents) AS documents, 0 AS wrong, 0 AS over FROM containers",
}
