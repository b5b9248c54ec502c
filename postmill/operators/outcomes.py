"""Outcomes and their corrections: append-only JSON lines by day, read back tolerantly and joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.operators import register
from postmill.sources.queue import read_lines

OUTCOME = """
schema STRING, id STRING, elaborato_il STRING, casella STRING, cliente STRING, casella_etichetta STRING, mittente STRING, oggetto STRING, data STRING, tipo_documento STRING, classe STRING,
instradamento STRUCT<tipo:STRING,alias:STRING,a:STRING,origine:STRING>, intervento_titolare BOOLEAN, sospetto STRUCT<livello:STRING,segnali:ARRAY<STRING>>, motivazione STRING,
confidenza STRUCT<livello:STRING,motivi:ARRAY<STRING>>, incerto BOOLEAN, direttive STRUCT<versione:STRING,regole:STRING>, regole_applicate ARRAY<STRING>, etichetta STRING,
modello STRUCT<token_in:BIGINT,token_out:BIGINT,cache_read:BIGINT>, errore STRING
""".replace("\n", " ")
CORRECTION = "schema STRING, id STRING, corretto_il STRING, campo STRING, proposto STRING, corretto STRING, autore STRING, nota STRING"
#: The register's keys and the SQL of what they group.
KEYS = {
    "per_confidenza": "confidenza.livello", "per_classe": "classe", "per_tipo_documento": "tipo_documento", "per_origine_instradamento": "instradamento.origine",
    "per_cliente": "cliente", "per_mittente": "mittente", "per_regola": "array_join(regole_applicate, ', ')",
}


def append(df: DataFrame, path: str, day: Column) -> None:
    """One JSON line for each row under its day; nothing that is there is ever rewritten.

    Each append makes files of its own, so that a line torn by an interruption cannot swallow a later one.
    """
    df.withColumn("giorno", day).write.mode("append").partitionBy("giorno").json(path)


def read(spark: SparkSession, path: str, schema: str, since: str = "", until: str = "", days: int | None = None) -> DataFrame:
    """Rows of the days asked for; blank, torn and non-object lines are left out. ``days``: the last ones that exist."""
    df = read_lines(spark, path, schema)
    if since:
        df = df.where(F.col("giorno") >= since)
    if until:
        df = df.where(F.col("giorno") <= until)
    if days is not None:
        last = df.select("giorno").distinct().orderBy(F.col("giorno").desc()).limit(days)
        df = df.join(F.broadcast(last), "giorno", "left_semi")
    return df


def explain(outcomes: DataFrame, corrections: DataFrame) -> DataFrame:
    """Each outcome with its corrections in order of time, an empty array where there are none."""
    fixes = corrections.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("corretto_il", "campo", "proposto", "corretto"))).alias("correzioni"))
    return outcomes.join(fixes, "id", "left").withColumn("correzioni", F.coalesce("correzioni", F.array().cast("array<struct<corretto_il:string,campo:string,proposto:string,corretto:string>>")))


def report(outcomes: DataFrame, corrections: DataFrame, keys: dict[str, str] = KEYS, key: str = "id") -> DataFrame:
    """The register over all keys in one pass; see ``register.register``."""
    return register.register(outcomes.select(key, *[F.expr(c).alias(n) for n, c in keys.items()]), corrections, list(keys), key)


def versions(outcomes: DataFrame) -> DataFrame:
    """The directive versions in use, ``version (rules)``, each once, sorted; a missing part is a question mark."""
    named = F.concat(F.coalesce("direttive.versione", F.lit("?")), F.lit(" ("), F.coalesce("direttive.regole", F.lit("?")), F.lit(")"))
    return outcomes.select(named.alias("version")).distinct().orderBy("version")


def tokens_used(outcomes: DataFrame) -> DataFrame:
    """Sums of the tokens that judging took."""
    return outcomes.agg(*[F.coalesce(F.sum(f"modello.{k}"), F.lit(0)).alias(k) for k in ("token_in", "token_out", "cache_read")])


def recipient(alias: Column, directory: dict[str, str]) -> Column:
    """The address of an alias in any letter case, empty where it is unknown."""
    if not directory:
        return F.lit("")
    table = F.create_map(*[F.lit(x) for k, v in directory.items() for x in (k.lower(), v)])
    return F.coalesce(F.try_element_at(table, F.lower(alias)), F.lit(""))
