"""Queries of whole operators: a crawl, redirects, an evaluation, a replay with planted changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldtrace.functions import canon, paths
from fieldtrace.operators import crawl as N, evaluator as W
from fieldtrace.plans import extract as E
from fieldtrace.queries.evaluation import CLASSES, _PR, _WILSON, _predictions, _scaled
from fieldtrace.queries.extraction import _customer_pages, _customer_recipe, _html
from fieldtrace.queries.registry import Registry
from fieldtrace.runtime import cut, table
from fieldtrace.sources.fetch import follow

query = Registry()

_HOST = "'https://' || CASE WHEN {n} % 2 = 0 THEN 'even' ELSE 'odd' END || '.example/' || {n}"


@query(f"""WITH RECURSIVE w AS (SELECT 1 AS n, 0 AS wave UNION SELECT t, wave + 1 FROM w, LATERAL (SELECT unnest([2 * n, 2 * n + 1]) AS t) WHERE t <= (SELECT count(*) FROM part))
SELECT {_HOST.format(n='n')} AS url, CAST(wave AS INT) AS wave, n - 1 AS position, CAST((row_number() OVER (PARTITION BY n % 2 ORDER BY n) - 1) * CASE WHEN n % 2 = 0 THEN 7 ELSE 2 END AS DOUBLE) AS planned_s FROM w""")
def crawl_policy(spark: SparkSession, d: str) -> DataFrame:
    """A crawl over two hosts with robots files: page n links to 2n, 2n+1, itself and home."""
    part = table(spark, d, "part")
    n = part.count()
    at = lambda c: F.concat(F.lit("https://"), F.when(c % 2 == 0, "even").otherwise("odd"), F.lit(".example/"), c)
    k = F.col("p_partkey") + 1
    links = F.filter(F.array(2 * k, 2 * k + 1, k, F.lit(1).cast("long")), lambda x: x <= n)
    body = F.to_json(F.struct(F.transform(links, at).alias("links")))
    captured = part.select(at(k).alias("url"), F.lit(200).alias("status"), F.lit("application/json; charset=utf-8").alias("content_type"), F.lit(None).cast("string").alias("location"), body.alias("body"))
    robots = spark.createDataFrame([("https://even.example", 200, "User-agent: *\nDisallow: /private\nCrawl-delay: 7\n"), ("https://odd.example", 404, None)], "origin string, status int, body string")
    seeds = spark.createDataFrame([("https://odd.example/1", 0), ("https://odd.example/1", 1)], "url string, ord int")

    def locate(pages: DataFrame) -> DataFrame:
        return pages.select("url", paths.json_path(F.try_parse_json(F.decode("body", "utf-8")), "$.links[*]").alias("values"))

    told = N.crawl(follow(captured), robots, seeds, locate, allowed=["even.example", "odd.example"], mode="json", max_pages=n, max_bytes=1 << 40, min_interval=2.0)
    return told.select("url", "wave", "position", "planned_s")


@query("""SELECT 'https://a.example/' || o_orderkey AS request_url, 'https://a.example/' || (o_orderkey // 4 * 4 + CASE WHEN o_orderkey % 4 = 3 THEN 3 ELSE 2 END) AS url, CAST(CASE WHEN o_orderkey % 4 = 3 THEN 'URL_POLICY_DENIED' END AS VARCHAR) AS error
FROM orders o WHERE o_orderkey % 4 = 3 OR (SELECT count(*) FROM orders p WHERE p.o_orderkey // 4 = o.o_orderkey // 4) = 4""")
def redirects(spark: SparkSession, d: str) -> DataFrame:
    """Pages in fours: the first leads to the second, that to the third; the fourth to plain HTTP."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    whole = o.groupBy(F.floor(F.col("k") / 4).alias("g")).agg(F.count("*").alias("n")).filter("n = 4").select("g")
    kept = o.withColumn("g", F.floor(F.col("k") / 4)).join(whole.withColumn("all", F.lit(True)), "g", "left").filter("all or k % 4 = 3")
    at = lambda c: F.concat(F.lit("https://a.example/"), c)
    to = F.when(F.col("k") % 4 < 2, at(F.col("k") + 1)).when(F.col("k") % 4 == 3, F.concat(F.lit("http://a.example/"), "k"))
    captured = kept.select(at(F.col("k")).alias("url"), F.lit(200).alias("status"), F.lit("text/html").alias("content_type"), to.alias("location"), F.lit("x").alias("body"))
    return follow(captured).select("request_url", "url", "error")


def _split(rows: DataFrame, odd: int) -> DataFrame:
    return rows.filter(F.col("id") % 2 == odd)


#: Two classes that may be accepted, and the wanted coverage.
CERTIFIED, COVERAGE = ["BUILDING", "MACHINERY"], 0.01


def _policy(spark: SparkSession, d: str) -> W.Policy:
    rows = cut(_split(_predictions(spark, d), 0))
    return W.fit_policy(rows.select("id", "label"), rows.select("id", "probabilities"), CLASSES, CERTIFIED, COVERAGE)


_FIT = _PR.replace("WHERE c_mktsegment IN", "WHERE c_custkey % 2 = {odd} AND c_mktsegment IN")
_TEMPERATURES = [0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 5.0, 8.0]
_TEMP = f"""tt AS (SELECT unnest({_TEMPERATURES}) AS t), sct AS (SELECT id, label, cls, t, exp(ln(greatest(p, 1e-12)) / t) AS e FROM pr, tt), spt AS (SELECT id, label, cls, t, e / sum(e) OVER (PARTITION BY id, t) AS p FROM sct),
best AS (SELECT t FROM (SELECT t, round(sum(-ln(greatest(p, 1e-12))), 6) AS nll FROM spt WHERE cls = label GROUP BY t) ORDER BY nll, t LIMIT 1)"""


@query(_FIT.format(odd=0) + _TEMP + f""", sp AS (SELECT id, label, cls, p FROM spt WHERE t = (SELECT t FROM best)), j AS (SELECT id, label, cls AS chosen, p AS confidence, CAST(cls = label AS INT) AS hit FROM sp QUALIFY row_number() OVER (PARTITION BY id ORDER BY p DESC, cls) = 1),
g AS (SELECT unnest(range(50, 101)) AS c), n AS (SELECT count(*) AS n FROM j), s AS (SELECT c / 100.0::DOUBLE AS threshold, count(confidence) AS accepted, CAST(coalesce(sum(hit), 0) AS BIGINT) AS correct FROM g LEFT JOIN (SELECT * FROM j WHERE chosen IN ('BUILDING', 'MACHINERY')) j ON floor(round(confidence * 100, 9)) >= c GROUP BY c)
SELECT CAST((SELECT t FROM best) AS DOUBLE) AS temperature, (SELECT min(threshold) FROM s, n WHERE accepted >= 100 AND round({_WILSON}, 6) >= 0.95 AND accepted >= {COVERAGE} * n) AS threshold""")
def evaluator_policy(spark: SparkSession, d: str) -> DataFrame:
    """Temperature and threshold fitted on the even customers."""
    p = _policy(spark, d)
    return spark.createDataFrame([(p.temperature, p.threshold)], "temperature double, threshold double")


_REPORT = """, c AS (SELECT label AS class FROM j UNION SELECT chosen FROM j), f AS (SELECT class, count_if(label = class AND chosen = class) AS tp, count_if(label <> class AND chosen = class) AS fp, count_if(label = class AND chosen <> class) AS fn FROM c, j GROUP BY class),
b AS (SELECT least(9, floor(confidence * 10)) AS bin, count(*) AS n, avg(confidence) AS c, avg(hit) AS a FROM j GROUP BY 1), grp AS (SELECT *, substr(label, 1, 1) <= 'F' AS lg, substr(chosen, 1, 1) <= 'F' AS cg FROM j),
sh AS (SELECT CASE WHEN hit = 1 THEN 3 WHEN lg = cg THEN 2 ELSE 1 END AS shared FROM grp), lat AS (SELECT (id * 13) % 101 + 1.0::DOUBLE AS l FROM j), rk AS (SELECT l, row_number() OVER (ORDER BY l) AS r FROM lat), n AS (SELECT count(*) AS n FROM j)
SELECT n AS test_examples, (SELECT round(avg(hit), 6) FROM j) AS leaf_accuracy, (SELECT round(avg(2.0 * tp / (2 * tp + fp + fn)), 6) FROM f) AS macro_f1, (SELECT round(avg(shared / 3.0), 6) FROM sh) AS ancestor_path_accuracy,
 (SELECT round(avg(6 - 2 * shared), 6) FROM sh) AS tree_distance, (SELECT round(sum(abs(c - a) * n) / sum(n), 6) FROM b) AS ece, (SELECT round(avg(s), 6) FROM (SELECT sum((p - CAST(cls = label AS INT)) ** 2) AS s FROM sp GROUP BY id)) AS brier,
 (SELECT l FROM rk WHERE r = ceil(n * 0.5)) AS p50_latency_ms, (SELECT l FROM rk WHERE r = ceil(n * 0.95)) AS p95_latency_ms, acc AS accepted, CAST(accc AS BIGINT) AS accepted_correct, round(acc / n, 6) AS coverage, round(1 - accc / acc, 6) AS selective_risk
FROM n, (SELECT count(*) AS acc, coalesce(sum(hit), 0) AS accc FROM j WHERE chosen IN ('BUILDING', 'MACHINERY') AND confidence >= 0.5) x"""


@query(_FIT.format(odd=1) + _scaled("0.5") + _REPORT)
def evaluator_report(spark: SparkSession, d: str) -> DataFrame:
    """All figures of the odd customers under a frozen policy."""
    rows = cut(_split(_predictions(spark, d), 1))
    group = lambda c: "first" if c[0] <= "F" else "second"
    tree = spark.createDataFrame([(c, ["root", group(c), c]) for c in CLASSES], "leaf string, path array<string>")
    took = rows.select("id", "probabilities", ((F.col("id") * 13) % 101 + 1.0).alias("latency_ms"))
    told = W.evaluate(rows.select("id", "label"), took, tree, W.Policy(0.5, 0.5, tuple(CERTIFIED), COVERAGE))
    near = ["leaf_accuracy", "macro_f1", "ancestor_path_accuracy", "tree_distance", "ece", "brier", "coverage", "selective_risk"]
    return told.select(*[F.round(c, 6).alias(c) if c in near else c for c in ("test_examples", "leaf_accuracy", "macro_f1", "ancestor_path_accuracy", "tree_distance", "ece", "brier", "p50_latency_ms", "p95_latency_ms", "accepted", "accepted_correct", "coverage", "selective_risk")])


@query("""SELECT 'https://crm.example/' || c_custkey AS url, CASE WHEN c_custkey % 97 = 5 THEN 'SNAPSHOT_CORRUPT' ELSE 'REPLAY_MISMATCH' END AS code FROM customer WHERE c_custkey % 97 = 5 OR c_custkey % 89 = 7""")
def replay_changed(spark: SparkSession, d: str) -> DataFrame:
    """A replay in which some pages have other bytes and others are gone."""
    pages, recipe = _customer_pages(spark, d), _customer_recipe()
    kept = cut(E.result_rows(E.extract(pages, recipe)))
    now = pages.filter("ord % 89 <> 7 or ord % 97 = 5").withColumn("body", F.when(F.col("ord") % 97 == 5, F.concat("body", F.lit(" "))).otherwise(F.col("body")))
    return E.replay(now, recipe, kept).select("url", "code")


@query("""SELECT count(*) FILTER (WHERE listing_id % 83 <> 4) AS same, count(*) FILTER (WHERE listing_id % 83 = 4) AS misaligned FROM products""")
def alignment_changed(spark: SparkSession, d: str) -> DataFrame:
    """Retained pages against a run in which some stand under another URL, others changed or are gone."""
    pages = _html(spark, d).select("ord", "url", canon.text_digest(F.col("body")).alias("now"))
    kept = pages.withColumnRenamed("now", "kept").withColumn("old_url", F.when((F.col("ord") % 83 == 4) & (F.col("ord") % 3 == 0), F.concat("url", F.lit("?old"))).otherwise(F.col("url"))).drop("url")
    kept = kept.withColumn("kept", F.when((F.col("ord") % 83 == 4) & (F.col("ord") % 3 == 1), F.lit("other")).otherwise(F.col("kept"))).filter("ord % 83 <> 4 or ord % 3 <> 2")
    both = pages.join(kept, "ord", "full")
    same = F.coalesce(F.col("url") == F.col("old_url"), F.lit(False)) & F.coalesce(F.col("now") == F.col("kept"), F.lit(False))
    return both.agg(F.count_if(same).alias("same"), F.count_if(~same).alias("misaligned"))


QUERIES, SQL = query.queries, query.sql
