"""Queries over the nested metadata record."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.operators import records
from postmill.sources.tables import read_table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every object that is an array element of a record, with its path."""
    return records.found(read_table(spark, sf_dir, "messages").select("id", "record"))


def p4_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The attachment child table: parent link, ordinal, name and content type."""
    df = read_table(spark, sf_dir, "messages").select("id", "record")
    rows = records.nodes(df).where(F.col("table") == "allegati")
    get = lambda k: F.try_variant_get("element", f"$.{k}", "string").alias(k)
    return rows.select("id", "parent_path", "node_path", "ordinal", get("nome"), get("content_type")).distinct()


def p4_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The child rows of every array level: level, parent link, path, ordinal and the element as JSON."""
    rows = records.nodes(read_table(spark, sf_dir, "messages").select("id", "record"))
    return rows.select("id", "table", "parent_path", "node_path", "ordinal", F.to_json("element").alias("element")).distinct()


_NAMES = ", ".join(f"'{x}'" for x in records.LONE_ARRAYS)
_WALK = f"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS n, id, r FROM (
    SELECT DISTINCT id, CASE WHEN r LIKE '"%' AND json_valid(r) THEN ltrim(json_extract_string(r, '$'), chr(65279) || E' \\t\\r\\n') ELSE r END AS r
    FROM (SELECT id, ltrim(record, chr(65279) || E' \\t\\r\\n') AS r FROM messages)
  ) WHERE r LIKE '{{%' AND json_valid(r)
), tree AS (
  SELECT d.n, d.id AS mid, t.id AS nid, t.parent AS up, t.key AS k, t.type AS ty, t.value AS v FROM docs d, json_tree(d.r) t
), walk AS (
  SELECT n, mid, nid, ty, v, '' AS path, false AS held, '' AS tab FROM tree WHERE up IS NULL
  UNION ALL
  SELECT t.n, t.mid, t.nid, t.ty, t.v,
    w.path || CASE WHEN w.path = '' THEN '' ELSE '/' END
      || CASE WHEN w.ty = 'ARRAY' THEN (CAST(t.k AS BIGINT) + 1)::VARCHAR WHEN t.ty = 'OBJECT' AND t.k IN ({_NAMES}) THEN t.k || '/1' ELSE t.k END,
    t.ty = 'OBJECT' AND (w.ty = 'ARRAY' OR t.k IN ({_NAMES})),
    CASE WHEN w.ty = 'ARRAY' THEN w.tab ELSE w.tab || '/' || t.k END
  FROM walk w JOIN tree t ON t.n = w.n AND t.up = w.nid
)
"""
QUERIES = {"p4_found": p4_found, "p4_attachments": p4_attachments, "p4_children": p4_children}
ORACLE = {
    "p4_found": _WALK + "SELECT DISTINCT mid AS id, path AS node_path FROM walk WHERE held",
    "p4_attachments": _WALK
    + """SELECT DISTINCT mid AS id, '' AS parent_path, path AS node_path, CAST(regexp_extract(path, '[0-9]+$') AS INT) AS ordinal,
  json_extract_string(v, '$.nome') AS nome, json_extract_string(v, '$.content_type') AS content_type FROM walk WHERE held AND tab = '/allegati'""",
}
