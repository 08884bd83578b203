"""Problem 6: month files whose fields drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.runtime import read_table
from cairn.sources.drift import ingest, schema_changes, vector_text


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_changes(read_table(spark, sf_dir, "finaltable_wide_raw"))


def p6_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every readable record with its typed columns and the rescue column as JSON."""
    return ingest(read_table(spark, sf_dir, "finaltable_wide_raw")).withColumn("rescued", F.to_json("rescued"))


def p6_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, row_no, submission_id, features (positions and values as text) and rescued_fields (their names in order) of every readable record."""
    x = ingest(read_table(spark, sf_dir, "finaltable_wide_raw"))
    names = F.array_join(F.array_sort(F.map_keys("rescued")), ",")
    return x.select("file_id", "row_no", "submission_id", vector_text(F.col("features")).alias("features"), names.alias("rescued_fields"))


_SPARSE = "'v:' || array_to_string(list_transform(list_sort(list_filter(list_zip({}, {}), lambda p: p[2] <> 0)), lambda p: p[1] || ':' || p[2]), ',')"
_LIST = "CASE WHEN regexp_extract(txt, '\\[([^\\]]*)\\]\\s*,\\s*\\[([^\\]]*)\\]', {0}) = '' THEN []::{1}[] ELSE string_split(regexp_extract(txt, '\\[([^\\]]*)\\]\\s*,\\s*\\[([^\\]]*)\\]', {0}), ',')::{1}[] END"
_CHANGES = f"""
WITH raw AS (
  SELECT series_id AS s, file_month AS m, file_id AS f, row_number() OVER () AS rid, row_no AS rn, record::JSON AS j
  FROM (SELECT * FROM finaltable_wide_raw WHERE json_valid(record)) WHERE json_type(record) = 'OBJECT'),
kv AS (SELECT s, m, f, rid, rn, e.key AS field, e.type AS t, e.value AS val, e.value->>'$' AS txt FROM raw, json_each(raw.j) AS e),
c AS (
  SELECT s, m, f, rid, rn, txt, field,
    CASE WHEN t = 'NULL' THEN NULL WHEN t = 'VARCHAR' THEN 'string' WHEN t IN ('UBIGINT', 'BIGINT', 'HUGEINT') THEN 'integer' WHEN t = 'DOUBLE' THEN 'fraction' ELSE lower(t) END AS kind,
    CASE WHEN t = 'NULL' THEN NULL
      WHEN t IN ('UBIGINT', 'BIGINT', 'HUGEINT', 'DOUBLE') THEN (txt::DOUBLE)::VARCHAR
      WHEN t = 'VARCHAR' AND try_cast(txt AS DOUBLE) IS NOT NULL THEN (try_cast(txt AS DOUBLE))::VARCHAR
      WHEN t = 'VARCHAR' AND regexp_matches(txt, '^\\s*\\(\\s*\\d+\\s*,\\s*\\[[^\\]]*\\]\\s*,\\s*\\[[^\\]]*\\]\\s*\\)\\s*$') THEN {_SPARSE.format(_LIST.format(1, "INTEGER"), _LIST.format(2, "DOUBLE"))}
      WHEN t = 'VARCHAR' THEN 's:' || txt
      WHEN t = 'OBJECT' AND json_exists(val, '$.indices') THEN {_SPARSE.format("(val->'$.indices')::INTEGER[]", "(val->'$.values')::DOUBLE[]")}
      WHEN t = 'ARRAY' THEN {_SPARSE.format("range(0, len(val::DOUBLE[]))", "val::DOUBLE[]")}
      ELSE 'j:' || val END AS canon
  FROM kv),
inv AS (
  SELECT s, m, f, field, coalesce(string_agg(DISTINCT kind, '+' ORDER BY kind), '') AS kinds,
    count(*) FILTER (kind IN ('string', 'integer') AND try_cast(canon AS DOUBLE) >= 100000 AND try_cast(canon AS DOUBLE) = floor(try_cast(canon AS DOUBLE))) AS ids
  FROM c GROUP BY 1, 2, 3, 4),
idf AS (SELECT f, field AS id_field FROM (SELECT *, row_number() OVER (PARTITION BY f ORDER BY (field = 'submission_id') DESC, ids DESC, field) AS k FROM inv WHERE ids > 0) WHERE k = 1),
files AS (SELECT f, lag(f) OVER (PARTITION BY s ORDER BY m) AS old FROM (SELECT DISTINCT s, m, f FROM inv)),
pairs AS (SELECT f AS pair, old FROM files WHERE old IS NOT NULL),
rec AS (SELECT c.f, c.canon AS sid, min(c.rid) AS rid FROM c JOIN idf ON idf.f = c.f AND idf.id_field = c.field WHERE c.canon IS NOT NULL GROUP BY 1, 2),
sh AS (SELECT pair, a.sid, a.rid AS new_rid, b.rid AS old_rid FROM pairs JOIN rec a ON a.f = pair JOIN rec b ON b.f = old AND b.sid = a.sid),
v AS (
  SELECT pair, true AS newer, field, string_agg(sid || '=' || canon, ';' ORDER BY sid) AS sig FROM sh JOIN c ON c.rid = new_rid WHERE canon IS NOT NULL GROUP BY 1, 2, 3
  UNION ALL
  SELECT pair, false, field, string_agg(sid || '=' || canon, ';' ORDER BY sid) FROM sh JOIN c ON c.rid = old_rid WHERE canon IS NOT NULL GROUP BY 1, 2, 3),
n AS (SELECT pair, field, kinds FROM pairs JOIN inv ON inv.f = pair),
o AS (SELECT pair, field, kinds FROM pairs JOIN inv ON inv.f = old),
gone AS (SELECT o.pair, o.field, o.kinds, sig, row_number() OVER (PARTITION BY o.pair, sig ORDER BY o.field) AS k FROM o ANTI JOIN n USING (pair, field) LEFT JOIN v ON v.pair = o.pair AND v.field = o.field AND NOT newer),
come AS (SELECT n.pair, n.field, n.kinds, sig, row_number() OVER (PARTITION BY n.pair, sig ORDER BY n.field) AS k FROM n ANTI JOIN o USING (pair, field) LEFT JOIN v ON v.pair = n.pair AND v.field = n.field AND newer),
ren AS (SELECT gone.pair, gone.field AS old_field, come.field AS new_field, gone.kinds AS was, come.kinds AS now FROM gone JOIN come ON gone.pair = come.pair AND gone.sig = come.sig AND gone.k = come.k)
SELECT pair AS file_id, 'renamed' AS change_kind, old_field, new_field FROM ren
UNION ALL SELECT pair, 'removed', field, '' FROM gone WHERE NOT EXISTS (SELECT 1 FROM ren WHERE ren.pair = gone.pair AND ren.old_field = gone.field)
UNION ALL SELECT pair, 'added', '', field FROM come WHERE NOT EXISTS (SELECT 1 FROM ren WHERE ren.pair = come.pair AND ren.new_field = come.field)
UNION ALL SELECT pair, 'retyped', old_field, new_field FROM ren WHERE was <> now AND was <> '' AND now <> ''
UNION ALL SELECT o.pair, 'retyped', o.field, n.field FROM o JOIN n USING (pair, field) WHERE o.kinds <> n.kinds AND o.kinds <> '' AND n.kinds <> ''
"""

_TYPED = _CHANGES[: _CHANGES.index("files AS (")] + """
vf AS (SELECT f, field AS vector_field FROM (SELECT f, field, row_number() OVER (PARTITION BY f ORDER BY (field = 'features') DESC, count(*) DESC, field) AS k FROM c WHERE canon LIKE 'v:%' GROUP BY 1, 2) WHERE k = 1),
x AS (
  SELECT c.*, coalesce(field = id_field AND kind IN ('string', 'integer') AND try_cast(canon AS DOUBLE) >= 100000, false) AS is_id, coalesce(field = vector_field AND canon LIKE 'v:%', false) AS is_vec
  FROM c LEFT JOIN idf ON idf.f = c.f LEFT JOIN vf ON vf.f = c.f)
SELECT raw.f AS file_id, raw.rn AS row_no, max(txt) FILTER (is_id) AS submission_id, max(canon) FILTER (is_vec) AS features, coalesce(string_agg(field, ',' ORDER BY field) FILTER (NOT is_id AND NOT is_vec), '') AS rescued_fields
FROM raw LEFT JOIN x ON x.rid = raw.rid GROUP BY raw.rid, raw.f, raw.rn
"""

QUERIES = {"p6_found": p6_found, "p6_records": p6_records, "p6_typed": p6_typed}
SQL = {"p6_found": _CHANGES, "p6_typed": _TYPED}
