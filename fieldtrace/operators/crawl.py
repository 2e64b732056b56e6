"""One crawl as one operator: policy, robots, throttle, types and budgets in the loop."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from fieldtrace.errors import FieldtraceError
from fieldtrace.operators.frontier import discover, numbered, robots_rule, url_policy
from fieldtrace.runtime import cut
from fieldtrace.sources.artifacts import mime_allowed


def origin_of(url: Column) -> Column:
    """Scheme, host and port of a URL; a port that is the scheme's own is left out."""
    plain = F.regexp_replace(F.lower(F.regexp_extract(url, r"^([A-Za-z]+://[^/?#]*)", 1)), r"^(http://[^/]*):80$|^(https://[^/]*):443$", "$1$2")
    return F.nullif(plain, F.lit(""))


def _refuse(rows: DataFrame) -> None:
    """Raises the first broken rule of a wave, in crawl order."""
    first = rows.filter("code is not null").agg(F.min(F.struct("position", "code", "url")).alias("e")).first()["e"]
    if first is not None:
        raise FieldtraceError(first["code"], first["url"])


def crawl(captured: DataFrame, robots: DataFrame, seeds: DataFrame, locate: Callable[[DataFrame], DataFrame], *, allowed: list[str], mode: str,
          max_pages: int, max_bytes: int, agent: str = "fieldtrace", min_interval: float = 0.0, next_only: bool = False) -> DataFrame:
    """(url, wave, position, planned_s, bytes, body) of a breadth-first crawl.

    ``captured``: (request_url, url, status, content_type, body, error), what
    ``sources.fetch.follow`` gives; ``robots``: (origin, status, body);
    ``seeds``: (url, ord); ``locate``: pages (url, body) -> (url, values), the
    link values found on each. Every wave is checked as a whole before its
    pages count, and the first page in crawl order that breaks a rule ends the
    crawl with its code: URL_POLICY_DENIED, DOMAIN_DENIED, PORT_DENIED,
    ROBOTS_UNAVAILABLE (a policy that is neither there nor known to be absent),
    ROBOTS_DENIED, HTTP_STATUS, MIME_UNSUPPORTED, a fetch error, or what link
    discovery refuses. More than ``max_pages`` pages or ``max_bytes`` bytes are
    LIMIT_REACHED: a part is never returned. ``planned_s`` is the start of a
    request when those of one origin keep the greater of ``min_interval`` and
    the delay its robots file asks for. No seeds give no rows.
    """
    policies = robots.select(F.col("origin").alias("__o"), F.col("status").alias("__rs"), F.col("body").alias("__rb")).dropDuplicates(["__o"])
    fetched = captured.select(F.col("request_url").alias("__u"), "status", "content_type", "error", F.col("body").alias("__body"))
    first = cut(seeds.filter("url is not null").groupBy("url").agg(F.min(F.struct(F.lit(0).alias("from"), F.col("ord"))).alias("at")).select("url", "at.*"))
    found, count, size, number = None, 0, 0, 0
    while (more := first.count()):
        if count + more > max_pages:
            raise FieldtraceError("LIMIT_REACHED", f"more than {max_pages} pages")
        wave = numbered(first, ["from", "ord", "url"], count).select("url", F.lit(number).alias("wave"), "position", origin_of(F.col("url")).alias("origin"))
        told = wave.join(policies, F.col("origin") == F.col("__o"), "left")
        told = told.withColumn("rule", robots_rule(F.when(F.col("__rs") == 200, F.col("__rb")), F.lit(agent), F.col("url")))
        told = told.join(fetched, F.col("url") == F.col("__u"), "left")
        code = (
            F.coalesce(url_policy(F.col("url"), allowed), F.when(F.col("__rs").isNull() | ~F.col("__rs").isin(200, 404, 410), "ROBOTS_UNAVAILABLE"))
        )
        code = F.coalesce(code, F.when(~F.col("rule.allowed"), "ROBOTS_DENIED"), F.col("error"), F.when(F.coalesce("status", F.lit(0)) != 200, "HTTP_STATUS"), F.when(~mime_allowed(F.lit(mode), F.col("content_type")), "MIME_UNSUPPORTED"))
        pages = cut(told.select("url", "wave", "position", "origin", F.greatest(F.lit(float(min_interval)), F.coalesce("rule.delay", F.lit(0.0))).alias("delay"),
                                F.octet_length("__body").cast("long").alias("bytes"), F.col("__body").alias("body"), code.alias("code")))
        _refuse(pages)
        size += pages.agg(F.sum("bytes")).first()[0] or 0
        if size > max_bytes:
            raise FieldtraceError("LIMIT_REACHED", f"more than {max_bytes} bytes")
        count, number = count + more, number + 1
        found = pages if found is None else cut(found.unionByName(pages))
        links = cut(discover(locate(pages.select("url", "body")), allowed, next_only).join(pages.select("url", "position"), "url"))
        _refuse(links.select("position", F.col("error").alias("code"), "url"))
        new = links.filter("target is not null").groupBy("target").agg(F.min(F.struct(F.col("position").alias("from"), "ord")).alias("at"))
        first = cut(new.join(found.select(F.col("url").alias("target")), "target", "left_anti").select(F.col("target").alias("url"), "at.*"))
    if found is None:
        return seeds.sparkSession.createDataFrame([], "url string, wave int, position long, planned_s double, bytes long, body binary")
    # starts are spaced by one delay per origin, so a start is its number times the delay;
    # a crawl has at most max_pages pages
    turn = F.row_number().over(Window.partitionBy("origin").orderBy("position")) - 1
    return found.withColumn("turn", turn).select("url", "wave", "position", (F.col("turn") * F.col("delay")).alias("planned_s"), "bytes", "body")
