"""URL policy, robots rules, link discovery and breadth-first crawl waves."""

from __future__ import annotations

import ipaddress
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from fieldtrace.errors import FieldtraceError
from fieldtrace.functions.text import resolve_url
from fieldtrace.runtime import cut

# Query keys that may carry secrets, letters only.
SECRET_KEYS = ["key", "apikey", "token", "accesstoken", "secret", "signature", "password", "authorization"]
_NAT64 = [ipaddress.ip_network("64:ff9b::/96"), ipaddress.ip_network("64:ff9b:1::/48")]


def url_policy(url: Column, allowed: list[str]) -> Column:
    """Null if the URL may be fetched, else the code of the first broken rule."""
    scheme = F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
    host = F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"\.$", "")
    authority = F.try_parse_url(url, F.lit("AUTHORITY"))
    keys = F.transform(F.split(F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit("")), "&"), lambda p: F.regexp_replace(F.lower(F.substring_index(p, "=", 1)), "[^a-z]", ""))
    secret = F.exists(keys, lambda k: k.isin(SECRET_KEYS))
    bad = scheme.isNull() | ~scheme.isin("http", "https") | host.isNull() | F.contains(authority, F.lit("@")) | F.contains(url, F.lit("#")) | secret
    port = F.regexp_extract(authority, r":([0-9]*)$", 1)
    wrong_port = (port != "") & ~port.isin("80", "443")
    return F.when(F.coalesce(bad, F.lit(True)), "URL_POLICY_DENIED").when(~host.isin(allowed), "DOMAIN_DENIED").when(wrong_port, "PORT_DENIED")


def is_public(address: str) -> bool:
    """Global unicast, and no address that tunnels to another network."""
    try:
        a = ipaddress.ip_address(address)
    except ValueError:
        return False
    if not a.is_global or a.is_multicast or a.is_reserved:
        return False
    if a.version == 6:
        if a.sixtofour is not None or a.teredo is not None or any(a in n for n in _NAT64):
            return False
        if a.ipv4_mapped is not None:
            return is_public(str(a.ipv4_mapped))
    return True


@pandas_udf(BooleanType())
def public_address(addresses: pd.Series) -> pd.Series:
    return addresses.map(lambda a: False if a is None else is_public(a))


@pandas_udf(StructType([StructField("allowed", BooleanType()), StructField("delay", DoubleType())]))
def robots_rule(robots: pd.Series, agents: pd.Series, urls: pd.Series) -> pd.DataFrame:
    """Whether a robots file lets an agent fetch a URL, and the delay it asks for.

    A null file allows everything; a request rate counts as seconds per request.
    """
    known: dict[str, RobotFileParser] = {}

    def one(rules, agent, url):
        if url is None:
            return (False, None)
        if rules is None:
            return (True, None)
        if rules not in known:
            known[rules] = RobotFileParser()
            known[rules].parse(rules.splitlines())
        p = known[rules]
        rate = p.request_rate(agent or "*")
        waits = [float(x) for x in (p.crawl_delay(agent or "*"), rate.seconds / rate.requests if rate else None) if x is not None]
        return (p.can_fetch(agent or "*", url), max(waits, default=None))

    return pd.DataFrame([one(*x) for x in zip(robots, agents, urls)], columns=["allowed", "delay"])


def discover(found: DataFrame, allowed: list[str], next_only: bool = False) -> DataFrame:
    """(url, ord, target, error) of located link values, resolved and checked.

    ``found``: (url, values array<variant>), what a locator gave on each page;
    a value may be a list of links. Values that are no strings are
    NAVIGATION_INVALID; with ``next_only`` more than one different link is
    NAVIGATION_AMBIGUOUS, one error per page. Links that break the URL policy,
    or lead from HTTPS to plain HTTP, carry the policy's code. Empty and null
    values are no links.
    """
    flat = F.flatten(F.transform("values", lambda v: F.when(F.schema_of_variant(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>")).otherwise(F.array(v))))
    useful = F.filter(flat, lambda v: v.isNotNull() & ~F.is_variant_null(v) & (F.to_json(v) != '""'))
    rows = found.select("url", useful.alias("links"))
    if next_only:
        several = F.size(F.array_distinct(F.transform("links", lambda v: F.to_json(v)))) > 1
        rows = rows.withColumn("several", several).withColumn("links", F.slice("links", 1, 1))
    else:
        rows = rows.withColumn("several", F.lit(False))
    each = rows.select("url", "several", F.posexplode("links").alias("ord", "v"))
    link = F.when(F.schema_of_variant("v") == "STRING", F.try_variant_get("v", "$", "string"))
    told = each.withColumn("link", link).withColumn("target", F.when(~F.col("several"), resolve_url(F.col("url"), F.col("link"))))
    down = F.lower("url").startswith("https:") & F.lower("target").startswith("http:")
    error = F.when(F.col("several"), "NAVIGATION_AMBIGUOUS").when(F.col("link").isNull(), "NAVIGATION_INVALID").when(F.coalesce(down, F.lit(False)), "URL_POLICY_DENIED").otherwise(url_policy(F.col("target"), allowed))
    return told.withColumn("error", error).select("url", "ord", F.when(F.col("error").isNull(), F.col("target")).alias("target"), "error")


#: Rows that one task may number.
ONE_TASK_ROWS = 100_000


def numbered(rows: DataFrame, order: list[str], start: int) -> DataFrame:
    """Adds ``position``: start, start + 1, ... in total order, without one task for all rows.

    Up to ``ONE_TASK_ROWS`` rows one task does it. Beyond, a written range sort; each sorted part is numbered by itself and shifted by
    the counts of the parts before it.
    """
    spark = rows.sparkSession
    if rows.count() <= ONE_TASK_ROWS:
        return rows.withColumn("position", F.row_number().over(Window.orderBy(*order)) - 1 + start)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = cut(rows.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    sizes = ordered.groupBy("__part").agg(F.count("*").alias("__n"))  # one row per part
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return ordered.withColumn("__place", place).join(F.broadcast(before), "__part").withColumn("position", F.col("__place") + F.col("__before") + start).drop("__part", "__place", "__before")


def crawl_waves(links: DataFrame, seeds: DataFrame, max_pages: int) -> DataFrame:
    """(url, wave, position): breadth-first order without repeats.

    ``links``: (url, ord, target); ``seeds``: (url, ord). Within a wave pages
    keep the order of their first discovery. Each wave is one join of the
    newly found pages with the links; pages seen before are dropped by an
    anti-join. It ends when nothing new is found; more than ``max_pages`` pages
    are LIMIT_REACHED, never a part of them. Seeds and links that are null lead
    nowhere; no seeds give no rows.
    """
    first = cut(seeds.filter("url is not null").groupBy("url").agg(F.min("ord").alias("ord")))
    count, number = first.count(), 0
    if count > max_pages:
        raise FieldtraceError("LIMIT_REACHED", f"more than {max_pages} pages")
    wave = cut(numbered(first, ["ord", "url"], 0).select("url", F.lit(0).alias("wave"), "position"))
    found = wave
    while True:
        number += 1
        told = wave.select(F.col("url"), F.col("position").alias("from")).join(links.filter("target is not null"), "url")
        new = told.groupBy("target").agg(F.min(F.struct("from", "ord")).alias("at")).join(found.select(F.col("url").alias("target")), "target", "left_anti")
        first = cut(new.select("at.from", "at.ord", "target"))
        more = first.count()
        if not more:
            break
        if count + more > max_pages:
            raise FieldtraceError("LIMIT_REACHED", f"more than {max_pages} pages")
        wave = cut(numbered(first, ["from", "ord", "target"], count).select(F.col("target").alias("url"), F.lit(number).alias("wave"), "position"))
        count += more
        found = cut(found.unionByName(wave))
    return found
