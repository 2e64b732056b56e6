"""Captured pages: recorded responses read as tables, redirects followed by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldtrace.runtime import cut

MAX_HOPS = 6
CAPTURED = "url string, status int, content_type string, location string, body string"


def captured_pages(spark: SparkSession, path: str) -> DataFrame:
    """Recorded responses (JSON lines) of a folder, through Spark's own reader."""
    return spark.read.schema(CAPTURED).json(path)


def follow(captured: DataFrame, max_bytes: int = 10_000_000, max_hops: int = MAX_HOPS) -> DataFrame:
    """(request_url, url, status, content_type, body, error) of every recorded request.

    ``captured``: (url, status, content_type, location, body). A response with
    a location leads on to the response of that URL, wherever it was recorded:
    each hop is one join of the requests still under way. More than
    ``max_hops`` hops, a target that wasn't recorded and a step from HTTPS down
    to HTTP are URL_POLICY_DENIED; a body above ``max_bytes`` is LIMIT_REACHED;
    both have a null body. Of a URL recorded more than once the greatest
    response counts. Responses without a URL are left out.
    """
    known = captured.filter("url is not null")
    one = cut(known.groupBy("url").agg(F.max(F.struct(F.coalesce("status", F.lit(200)).alias("status"), "content_type", F.nullif("location", F.lit("")).alias("location"), "body")).alias("r")).select("url", "r.*"))
    way = one.select(F.col("url").alias("request_url"), "url", "location", F.lit(None).cast("string").alias("error"))
    ended = []
    for hop in range(max_hops + 1):
        ended.append(way.filter("location is null or error is not null").select("request_url", "url", "error"))
        open_ = way.filter("location is not null and error is null")
        if hop == max_hops:
            ended.append(open_.select("request_url", "url", F.lit("URL_POLICY_DENIED").alias("error")))
            break
        if open_.isEmpty():
            break
        target = one.select(F.col("url").alias("to"), F.col("location").alias("next"))
        step = open_.join(target, F.col("location") == F.col("to"), "left")
        down = F.lower("url").startswith("https:") & F.lower("location").startswith("http:")
        error = F.when(F.col("to").isNull() | down, "URL_POLICY_DENIED")
        way = cut(step.select("request_url", F.coalesce(F.when(error.isNull(), F.col("to")), F.col("url")).alias("url"), F.col("next").alias("location"), error.alias("error")))
    every = ended[0]
    for more in ended[1:]:
        every = every.unionByName(more)
    told = every.join(one.drop("location"), "url")
    large = F.octet_length("body") > max_bytes
    error = F.coalesce("error", F.when(large, "LIMIT_REACHED"))
    return told.select("request_url", "url", "status", "content_type", F.when(error.isNull(), F.encode("body", "utf-8")).alias("body"), error.alias("error"))
