"""Queries of the general training-data problems 1, 5 and 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldtrace.operators import hierarchy as H
from fieldtrace.operators import orphans as O
from fieldtrace.operators import snapshots as S
from fieldtrace.runtime import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = H.latest_rows(table(spark, sf_dir, "classification_tree").select("id", "parent_id", "scheme_id", "loaded_at"))
    return H.hierarchy(rows, locality="scheme_id")


def p1_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.descendants(p1_found(spark, sf_dir))


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    products = table(spark, sf_dir, "products").select("listing_id", "type_id", "classification_path", "scraped_at")
    reviews = table(spark, sf_dir, "spot_reviews").select("review_id", "proposed_type_id", "reviewed_at")
    ref = lambda field, ids: F.struct(F.lit(field).alias("field_name"), ids.alias("ids"))
    fields = F.array(ref("type_id", F.array(O.spelled_integer(F.col("type_id")))), ref("classification_path", O.path_ids(F.col("classification_path"))))
    listed = products.select(F.lit("products").alias("table_name"), F.col("listing_id").alias("record_id"), F.col("scraped_at").alias("at"), F.explode(fields).alias("f"))
    listed = listed.select("table_name", "record_id", F.col("f.field_name"), F.explode("f.ids").alias("ref_id"), "at")
    proposed = reviews.select(
        F.lit("spot_reviews").alias("table_name"), F.col("review_id").alias("record_id"), F.lit("proposed_type_id").alias("field_name"),
        F.col("proposed_type_id").cast("long").alias("ref_id"), F.col("reviewed_at").alias("at"))
    return listed.unionByName(proposed)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = table(spark, sf_dir, "classification_tree").select("id", "created_at", "deleted_at", "loaded_at")
    return O.orphans(_references(spark, sf_dir), H.latest_rows(tree).drop("loaded_at"))


def p5_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.orphan_counts(p5_found(spark, sf_dir))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.snapshot_changes(table(spark, sf_dir, "resource_snapshots"), table(spark, sf_dir, "snapshot_log"))


def p6_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_found(spark, sf_dir).groupBy("workspace", "snapshot_no", "change_type").agg(F.count("*").alias("records"))


QUERIES = {f.__name__: f for f in (p1_found, p1_descendants, p5_found, p5_counts, p6_found, p6_counts)}

_LATEST = """latest AS (SELECT * FROM classification_tree WHERE id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC NULLS LAST) = 1)"""

_P1 = f"""WITH RECURSIVE {_LATEST},
links AS (SELECT l.id, p.id AS parent FROM latest l LEFT JOIN latest p ON l.parent_id = p.id),
walk AS (
  SELECT id, id AS root_id, 1 AS depth, CAST(id AS VARCHAR) AS full_path FROM links WHERE parent IS NULL
  UNION ALL
  SELECT l.id, w.root_id, w.depth + 1, w.full_path || '.' || CAST(l.id AS VARCHAR) FROM links l JOIN walk w ON l.parent = w.id),
rest AS (SELECT id, parent FROM links WHERE id NOT IN (SELECT id FROM walk)),
up AS (SELECT id, parent AS above FROM rest UNION SELECT u.id, r.parent FROM up u JOIN rest r ON u.above = r.id),
loops AS (SELECT id FROM up WHERE id = above),
least AS (SELECT u.id, min(u.above) AS root_id FROM up u JOIN loops l ON u.above = l.id GROUP BY u.id),
solved AS (SELECT id, root_id, CAST(depth AS INT) AS depth, full_path FROM walk
  UNION ALL SELECT id, root_id, 0, 'cycle' FROM least)"""

_REFS = f"""WITH {_LATEST},
raw_refs AS (
  SELECT 'products' AS table_name, listing_id AS record_id, 'type_id' AS field_name,
    CASE WHEN regexp_matches(regexp_replace(type_id, '^\\s+|\\s+$', '', 'g'), '^[+-]?[0-9]+(\\.0)?$')
      THEN TRY_CAST(regexp_replace(regexp_replace(type_id, '^\\s+|\\s+$', '', 'g'), '\\.0$', '') AS BIGINT) END AS ref_id, scraped_at AS moment
  FROM products
  UNION ALL
  SELECT 'products', listing_id, 'classification_path', TRY_CAST(unnest(list_distinct(regexp_extract_all(classification_path, '[0-9]+'))) AS BIGINT), scraped_at FROM products
  UNION ALL
  SELECT 'spot_reviews', review_id, 'proposed_type_id', proposed_type_id, reviewed_at FROM spot_reviews),
found AS (
  SELECT DISTINCT table_name, record_id, field_name, ref_id,
    CASE WHEN l.id IS NULL THEN 'missing' WHEN l.created_at > moment THEN 'late' WHEN l.deleted_at <= moment THEN 'deleted' END AS reason,
    strftime(moment, '%Y-%m') AS period
  FROM raw_refs r LEFT JOIN latest l ON r.ref_id = l.id WHERE r.ref_id IS NOT NULL)"""

_P6 = r"""WITH done AS (SELECT *, lag(snapshot_no) OVER w AS earlier, lead(snapshot_no) OVER w AS later FROM (SELECT DISTINCT workspace, snapshot_no FROM snapshot_log WHERE lower(trim(status)) = 'complete') WINDOW w AS (PARTITION BY workspace ORDER BY snapshot_no)),
r AS (SELECT row_number() OVER () AS n, s.workspace, s.snapshot_no, earlier, later, lower(regexp_replace(kind, '^\s+|\s+$', '', 'g')) AS kind, id, data, version, loaded_at FROM resource_snapshots s JOIN done USING (workspace, snapshot_no) WHERE kind IS NOT NULL AND id IS NOT NULL),
one AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY workspace, snapshot_no, kind, id ORDER BY version DESC NULLS LAST, loaded_at DESC NULLS LAST, data) = 1),
ok AS (SELECT *, data IS NOT NULL AND json_valid(data) AS valid FROM one),
t AS (SELECT n, CASE WHEN j.type IN ('OBJECT', 'ARRAY') THEN j.fullkey || chr(1) || j.type WHEN j.type IN ('UBIGINT', 'BIGINT', 'HUGEINT', 'DOUBLE') THEN j.fullkey || chr(1) || CAST(CAST(j.atom AS VARCHAR)::DOUBLE + 0.0 AS VARCHAR) ELSE j.fullkey || chr(1) || j.type || coalesce(json_extract_string(j.value, '$'), '') END AS leaf FROM ok, json_tree(CASE WHEN valid THEN data END) j WHERE valid),
canon AS (SELECT n, string_agg(leaf, chr(2) ORDER BY leaf) AS text FROM t GROUP BY n),
v AS (SELECT ok.*, CASE WHEN data IS NULL THEN 'absent' WHEN valid THEN 'j' || coalesce(text, '') ELSE 't' || data END AS body FROM ok LEFT JOIN canon USING (n)),
pairs AS (SELECT workspace, snapshot_no, earlier FROM done WHERE earlier IS NOT NULL),
a AS (SELECT p.workspace, p.snapshot_no AS pair, v.kind, v.id, v.body FROM pairs p JOIN v ON v.workspace = p.workspace AND v.snapshot_no = p.snapshot_no),
b AS (SELECT p.workspace, p.snapshot_no AS pair, v.kind, v.id, v.body FROM pairs p JOIN v ON v.workspace = p.workspace AND v.snapshot_no = p.earlier),
f AS (SELECT coalesce(a.workspace, b.workspace) AS workspace, coalesce(a.kind, b.kind) AS kind, coalesce(a.id, b.id) AS id, CAST(coalesce(a.pair, b.pair) AS INT) AS snapshot_no,
 CASE WHEN b.body IS NULL THEN 'added' WHEN a.body IS NULL THEN 'removed' WHEN a.body <> b.body THEN 'changed' END AS change_type
 FROM a FULL JOIN b ON a.workspace = b.workspace AND a.pair = b.pair AND a.kind = b.kind AND a.id = b.id)"""

SQL = {
    "p1_found": _P1 + " SELECT * FROM solved",
    "p1_descendants": _P1 + """
SELECT CAST(parts[k] AS BIGINT) AS ancestor_id, id AS descendant_id, CAST(depth - k AS INT) AS distance
FROM (SELECT id, depth, string_split(full_path, '.') AS parts, unnest(range(1, depth)) AS k FROM solved WHERE depth > 1)""",
    "p5_found": _REFS + " SELECT * FROM found WHERE reason IS NOT NULL",
    "p5_counts": _REFS + " SELECT table_name, field_name, reason, period, count(*) AS orphans, count(DISTINCT ref_id) AS ref_ids FROM found WHERE reason IS NOT NULL GROUP BY ALL",
    "p6_found": _P6 + " SELECT workspace, kind, id, snapshot_no, change_type FROM f WHERE change_type IS NOT NULL",
    "p6_counts": _P6 + " SELECT workspace, snapshot_no, change_type, count(*) AS records FROM f WHERE change_type IS NOT NULL GROUP BY ALL",
}
