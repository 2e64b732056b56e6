"""Crawls, evaluations, leases and folds as whole operators."""

import math
import random

import pytest
from pyspark.sql import functions as F

from fieldtrace.errors import FieldtraceError
from fieldtrace.functions import paths
from fieldtrace.operators import crawl as N, evaluate as V, evaluator as W
from fieldtrace.sources.fetch import follow
from fieldtrace.streaming import leases as L


def locate(pages):
    return pages.select("url", paths.json_path(F.try_parse_json(F.decode("body", "utf-8")), "$.links[*]").alias("values"))


ROBOTS = "User-agent: *\nDisallow: /no\nCrawl-delay: 3\n"


def crawled(spark, pages, robots=(("https://a.example", 200, ROBOTS),), **limits):
    captured = spark.createDataFrame([(u, s, t, None, b) for u, s, t, b in pages], "url string, status int, content_type string, location string, body string")
    seeds = spark.createDataFrame([("https://a.example/1", 0)], "url string, ord int")
    given = {"allowed": ["a.example"], "mode": "json", "max_pages": 10, "max_bytes": 10_000} | limits
    return N.crawl(follow(captured), spark.createDataFrame(list(robots), "origin string, status int, body string"), seeds, locate, **given)


def page(n, *links, status=200, kind="application/json"):
    return (f"https://a.example/{n}", status, kind, '{"links":[' + ",".join(f'"https://a.example/{x}"' for x in links) + "]}")


def test_crawl_in_order_with_delays(spark):
    got = crawled(spark, [page(1, 3, 2, 1), page(2, 4), page(3, 4), page(4)]).orderBy("position").collect()
    assert [(r["url"][-1], r["wave"], r["planned_s"]) for r in got] == [("1", 0, 0.0), ("3", 1, 3.0), ("2", 1, 6.0), ("4", 2, 9.0)]
    none = crawled(spark, [page(1)], robots=[("https://a.example", 404, None)])
    assert none.count() == 1


@pytest.mark.parametrize("code, pages, robots, limits", [
    ("ROBOTS_DENIED", [page(1, "no/2"), page("no/2")], None, {}), ("ROBOTS_UNAVAILABLE", [page(1)], [("https://a.example", 503, None)], {}), ("ROBOTS_UNAVAILABLE", [page(1)], [("https://b.example", 200, "")], {}),
    ("HTTP_STATUS", [page(1, 2), page(2, status=500)], None, {}), ("HTTP_STATUS", [page(1, 2)], None, {}), ("MIME_UNSUPPORTED", [page(1, kind="text/html")], None, {}),
    ("LIMIT_REACHED", [page(1, 2, 3), page(2), page(3)], None, {"max_pages": 2}), ("LIMIT_REACHED", [page(1, 2), page(2)], None, {"max_bytes": 20}), ("DOMAIN_DENIED", [page(1)], None, {"allowed": ["b.example"]})])
def test_the_first_broken_rule_ends_a_crawl(spark, code, pages, robots, limits):
    with pytest.raises(FieldtraceError, match=code):
        crawled(spark, pages, robots or [("https://a.example", 200, ROBOTS)], **limits)


def test_evaluator(spark):
    rnd = random.Random(1)
    leaves = ["a", "b", "c"]

    def rows(ids):
        out = []
        for k in ids:
            label = rnd.choice(leaves)
            p = {x: (0.98 if x == label else 0.01) for x in leaves} if rnd.random() < 0.97 else {x: (0.5 if x == "a" else 0.25) for x in leaves}
            out.append((k, label, p, float(k % 7)))
        return spark.createDataFrame(out, "id long, label string, probabilities map<string,double>, latency_ms double"), out

    fit, _ = rows(range(400))
    policy = W.fit_policy(fit.select("id", "label"), fit.select("id", "probabilities"), leaves, ["a", "b"], 0.5)
    assert policy.threshold is not None and policy.temperature in V.TEMPERATURES
    assert W.fit_policy(fit.select("id", "label"), fit.select("id", "probabilities"), leaves, ["a", "b"], 0.99).threshold is None
    test, raw = rows(range(300))
    paths_ = spark.createDataFrame([(x, ["r", "g" if x < "c" else "h", x]) for x in leaves], "leaf string, path array<string>")
    got = W.evaluate(test.select("id", "label"), test.select("id", "probabilities", "latency_ms"), paths_, W.Policy(1.0, 0.9, ("a", "b"), 0.5)).first()
    chosen = [min(p, key=lambda x: (-p[x], x)) for _, _, p, _ in raw]
    hits = [c == r[1] for c, r in zip(chosen, raw)]
    took = [c in "ab" and r[2][c] >= 0.9 - 1e-12 for c, r in zip(chosen, raw)]
    shared = [3 if h else 2 if (c < "c") == (r[1] < "c") else 1 for c, r, h in zip(chosen, raw, hits)]
    assert got["test_examples"] == 300 and got["leaf_accuracy"] == pytest.approx(sum(hits) / 300) == got["micro_f1"]
    assert got["ancestor_path_accuracy"] == pytest.approx(sum(shared) / 900) and got["tree_distance"] == pytest.approx(sum(6 - 2 * s for s in shared) / 300)
    assert got["accepted"] == sum(took) and got["accepted_correct"] == sum(t and h for t, h in zip(took, hits))
    assert got["selective_risk"] == pytest.approx(1 - got["accepted_correct"] / got["accepted"]) and got["coverage"] == pytest.approx(sum(took) / 300)
    latency = sorted(r[3] for r in raw)
    assert (got["p50_latency_ms"], got["p95_latency_ms"]) == (latency[math.ceil(150) - 1], latency[math.ceil(285) - 1])
    nothing = W.evaluate(test.select("id", "label"), test.select("id", "probabilities", "latency_ms"), paths_, W.Policy(1.0, None, ("a",), 0.5)).first()
    assert nothing["accepted"] == 0 and nothing["selective_risk"] is None
    with pytest.raises(FieldtraceError, match="unpredicted: 1"):
        W.check_rows(test.select("id", "label"), test.filter("id <> 3").select("id", "probabilities"), leaves)
    with pytest.raises(FieldtraceError, match="other classes"):
        W.check_rows(test.select("id", "label"), test.select("id", "probabilities"), ["a", "b"])


def test_nearest_ranks_equal_sorting(spark):
    rnd = random.Random(2)
    values = [rnd.choice([1.0, 2.0, 2.0, rnd.random() * 9]) for _ in range(501)]
    got = V.nearest_ranks(spark.createDataFrame([(v,) for v in values] + [(None,)], "x double").repartition(5), "x", {"a": 0.5, "b": 0.95, "c": 1.0}).first()
    s = sorted(values)
    assert tuple(got) == (s[math.ceil(501 * 0.5) - 1], s[math.ceil(501 * 0.95) - 1], s[-1])
    assert tuple(V.nearest_ranks(spark.createDataFrame([], "x double"), "x", {"a": 0.5}).first()) == (None,)


LOG = [(1, "enqueue", None, None, 0), (2, "claim", "w1", None, 10), (3, "claim", "w2", None, 20), (4, "heartbeat", "w1", 1, 60), (5, "heartbeat", "w1", 1, 130), (6, "claim", "w2", None, 131), (7, "complete", "w1", 1, 140), (8, "complete", "w2", 2, 150), (9, "claim", "w3", None, 400)]
TOLD = ["queued", "claimed", "busy", "extended", "LEASE_LOST", "claimed", "LEASE_LOST", "completed", "busy"]


def test_leases(spark):
    rows = [(7, *r) for r in LOG] + [(8, 1, "claim", "w", None, 5)] + [(9, k + 1, "claim" if k else "enqueue", "w", None, 100 * k) for k in range(6)] + [(None, 1, "claim", "w", None, 5)]
    df = spark.createDataFrame(rows, "job long, seq long, kind string, owner string, generation long, at long")
    got = {(r["job"], r["seq"]): r["outcome"] for r in L.lease_log(df).collect()}
    assert [got[7, k + 1] for k in range(9)] == TOLD and got[8, 1] == "unknown"
    assert [got[9, k + 1] for k in range(6)] == ["queued", "claimed", "claimed", "claimed", "RETRIES_EXHAUSTED", "busy"] and len(got) == 16
    assert L.lease_log(df.limit(0)).count() == 0


def test_leases_end_by_timers_on_a_stream(spark, tmp_path):
    from fieldtrace.streaming.events import run_to_table, state_session

    parts = [[(7, *r) for r in LOG[:2]], [(8, 1, "enqueue", None, None, 500)], [(8, 2, "claim", "w9", None, 900)]]
    for n, part in enumerate(parts):
        rows = spark.createDataFrame(part, "job long, seq long, kind string, owner string, generation long, at long").withColumn("ts", F.timestamp_seconds(F.col("at") + 1_000)).drop("at")
        rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = state_session(spark).readStream.schema("job long, seq long, kind string, owner string, generation long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = {(r["job"], r["kind"], r["outcome"]) for r in run_to_table(L.lease_stream(stream)).collect()}
    assert (7, "claim", "claimed") in got and (7, "timer", "expired") in got and (8, "claim", "claimed") in got
