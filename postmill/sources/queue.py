"""Readers of the message queue, JSON line files and mail files, tolerant of broken rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The queue record; both schema versions read into it, missing fields become null.
RECORD = """
schema STRING, id STRING, acquisito_il STRING, casella STRUCT<id:STRING,etichetta:STRING,indirizzo:STRING,cliente:STRING>, tipo STRING, certificato BOOLEAN,
data STRUCT<certificata:STRING,invio:STRING,ricezione:STRING>, mittente STRUCT<indirizzo:STRING,nome:STRING,dominio:STRING>, destinatari ARRAY<STRING>, copia ARRAY<STRING>, oggetto STRING,
allegati ARRAY<STRUCT<nome:STRING,nome_file:STRING,content_type:STRING,byte:BIGINT,sha256:STRING,salvato:BOOLEAN,testo:STRUCT<method:STRING,status:STRING,chars:BIGINT>>>,
message_id STRING, gestore STRING, note ARRAY<STRING>, _corrupt STRING
""".replace("\n", " ")


def read_queue(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(items, problems): records with an id in order of date, and the files that hold none."""
    df = spark.read.schema(RECORD).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    df = df.withColumn("file", F.col("_metadata.file_path"))
    good = F.col("id").isNotNull() & F.col("_corrupt").isNull()
    date = F.coalesce("data.certificata", "data.invio", "data.ricezione", "acquisito_il")
    return df.where(good).withColumn("ts", F.try_to_timestamp(date)).orderBy(F.col("ts").isNull(), "ts", "file").drop("_corrupt"), df.where(~good).select("file", "_corrupt")


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines and the columns of their folders; blank, torn and non-object lines are left out."""
    lines = spark.read.text(path)
    folders = [c for c in lines.columns if c != "value"]
    lines = lines.select(F.from_json("value", schema + ", _bad STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"), "value", *folders)
    return lines.where((F.trim("value") != "") & F.trim("value").startswith("{") & F.col("r._bad").isNull()).select("r.*", *folders).drop("_bad")


def read_mail_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, raw) of mail files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.eml").load(path).select("path", F.col("length").alias("size"), F.col("content").alias("raw"))


def safe_path(base, relative):
    """``base``/``relative`` where the relative path stays inside, else null (as a Column)."""
    parts = F.split(F.translate(relative, "\\", "/"), "/")
    outside = relative.startswith("/") | F.array_contains(parts, "..") | relative.contains(":")
    return F.when(~outside & (relative != ""), F.concat(base, F.lit("/"), F.translate(relative, "\\", "/")))
