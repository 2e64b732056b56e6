"""Recipe -> DataFrame plan: records, evidence, quarantine, merge, diff, replay.

Every field is a column of its own, so a query for the data alone plans no
evidence. JSON locators are VARIANT expressions; HTML is parsed once per page,
for all locators. Only the last step of a record, canonical text with schema
check and id, needs Python for JSON, in Arrow batches. All of this is narrow;
shuffles arise only where identities are merged or compared.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from fieldtrace.errors import FieldtraceError
from fieldtrace.functions import canon, dom, paths, transforms as X
from fieldtrace.operators.skew import salted_join
from fieldtrace.plans.recipe import Recipe
from fieldtrace.plans.validate import check_schema, failures, native_checks
from fieldtrace.runtime import beside, cut

_ABSENT = object()
_FINISHED = StructType([StructField("data", StringType()), StructField("failed", ArrayType(StringType())), StructField("record_id", StringType())])


def _jsonld(root: dom.Node, pointer: str) -> list:
    """Values at ``pointer`` in every JSON-LD object, @graph members included."""

    def get(v, parts):
        for p in parts:
            if isinstance(v, dict) and p in v:
                v = v[p]
            elif isinstance(v, list) and p.isdigit() and str(int(p)) == p and int(p) < len(v):
                v = v[int(p)]
            else:
                return _ABSENT
        return v

    parts = paths.pointer_parts(pointer if pointer.startswith("/") else f"/{pointer}")
    out = []
    for script in dom.select(root, 'script[type="application/ld+json"]'):
        try:
            loaded = canon.loads_strict(script.raw())
        except ValueError:
            continue
        open_ = loaded if isinstance(loaded, list) else [loaded]
        for one in open_:
            if isinstance(one, dict):
                if isinstance(one.get("@graph"), list):
                    open_.extend(one["@graph"])  # read after the objects already listed
                found = get(one, parts)
                if found is not _ABSENT:
                    out.append(found)
    return out


def html_roots(recipe: Recipe):
    """UDF: html -> struct<error, roots: array<array<array<json text>>>>."""
    scope = dom.compile_selector(recipe.scope.value) if recipe.scope.type == "container_selector" else None
    rules = [(f.locator.type, f.locator, dom.compile_selector(f.locator.value) if f.locator.type.startswith("css") else None) for _, f in sorted(recipe.fields.items())]
    kind = StructType([StructField("error", StringType()), StructField("roots", ArrayType(ArrayType(ArrayType(StringType()))))])

    def locate(root, rule):
        how, locator, chains = rule
        if how == "css_text":
            found = [n.text(" ") for n in dom.select(root, chains)]
        elif how == "css_attr":
            found = [n.get(locator.attribute) for n in dom.select(root, chains) if locator.attribute in n.attrs]
        else:
            found = _jsonld(root, locator.value)
        return [json.dumps(v, ensure_ascii=False) for v in found]

    def one(html):
        if html is None:
            return ("SNAPSHOT_INVALID", None)
        tree = dom.parse(html)
        roots = [tree] if scope is None else dom.select(tree, scope)
        chosen = set(map(id, roots))
        for n in roots:
            up = n.parent
            while up is not None:
                if id(up) in chosen:
                    return ("RECORD_SCOPE_OVERLAP", None)
                up = up.parent
        return (None, [[locate(r, rule) for rule in rules] for r in roots])

    @pandas_udf(kind)
    def run(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(p) for p in pages], columns=["error", "roots"])

    return run


def _finisher(recipe: Recipe, workspace: str):
    """UDF: assembled data -> canonical text, failed pointers, record id."""
    schema, identity = recipe.schema, [paths.pointer_parts(p) for p in recipe.identity]
    check_schema(schema)

    def one(text):
        if text is None:
            return (None, None, None)
        data = json.loads(text)
        failed = sorted({f"{p}:VALIDATION_FAILED" for p in failures(data, schema)})
        ids = []
        for parts in identity:
            v = data
            for p in parts:
                v = v.get(p) if isinstance(v, dict) else None
            ids.append(v)
        try:
            whole = canon.canonical(data)
            return (whole, failed, None if any(v is None or v == "" for v in ids) else canon.object_hash([workspace, recipe.source_id, ids]))
        except ValueError:  # a number that canonical JSON can't hold
            return (text, sorted({*failed, "/:VALIDATION_FAILED"}), None)

    @pandas_udf(_FINISHED)
    def run(texts: pd.Series) -> pd.DataFrame:
        if texts.isna().all():
            return pd.DataFrame({"data": [None] * len(texts), "failed": None, "record_id": None})
        return pd.DataFrame([one(t) for t in texts], columns=["data", "failed", "record_id"])

    return run


def _finish(df: DataFrame, recipe: Recipe, workspace: str, ready: dict[str, Column]) -> DataFrame:
    """Adds __data, __failed, __record_id to rows with __json.

    Members are written in canonical order, so the built-in JSON text is
    already canonical unless it holds escapes, fractions, exponents, long
    integers or nested values. Those rows, and schemas beyond flat ones, take
    the general way in Python; the others never leave the JVM.
    """
    check_schema(recipe.schema)
    parts = {p: paths.pointer_parts(p) for p in ready}
    flat = all(len(x) == 1 for x in parts.values())
    checks = native_checks(recipe.schema, {parts[p][0]: c for p, c in ready.items()}) if flat else None
    general = _finisher(recipe, workspace)
    if checks is None:
        df = df.withColumn("__done", general(F.col("__json")))
        return df.select("*", F.col("__done.data").alias("__data"), F.col("__done.failed").alias("__failed"), F.col("__done.record_id").alias("__record_id"))
    plain = ~F.col("__json").rlike(r"\\|[0-9][.][0-9]|[0-9][eE][+-]?[0-9]|[0-9]{16}|.[{\[]")
    identity = [ready[p] for p in recipe.identity]
    told = F.lit(True)
    for v in identity:
        told = told & v.isNotNull() & (F.to_json(v) != '""')
    ids = F.concat_ws(",", *[F.to_json(v) for v in identity])
    key = F.sha2(F.concat(F.lit(canon.canonical([workspace, recipe.source_id])[:-1] + ",["), ids, F.lit("]]")), 256)
    failed = F.array_sort(F.array_distinct(F.array_compact(F.array(*checks)))) if checks else F.array().cast("array<string>")
    df = df.withColumn("__plain", plain).withColumn("__done", general(F.when(~F.col("__plain"), F.col("__json"))))
    mine = lambda native, done: F.when(F.col("__plain"), native).otherwise(F.col(f"__done.{done}"))
    return df.select("*", mine(F.col("__json"), "data").alias("__data"), mine(failed, "failed").alias("__failed"), mine(F.when(told, key), "record_id").alias("__record_id"))


@pandas_udf(StringType())
def _strict(texts: pd.Series) -> pd.Series:
    """The text itself if it is strict JSON, else null."""

    def one(t):
        try:
            canon.loads_strict(t)
            return t
        except ValueError:
            return None

    return texts.map(one, na_action="ignore")


def parse_strict(text: Column) -> Column:
    """Strict JSON as a variant, null where invalid.

    The built-in parser refuses repeated keys and NaN, but not what follows a
    value: wrapped in an array, a rest can only hide behind a closing bracket, so
    texts that hold one are wrapped in an object as well; any rest breaks one of
    the two. Only texts with huge exponents or many brackets are looked
    at again in Python.
    """
    doubtful = text.rlike(r"[0-9][eE][+]?[0-9]{3}") | (F.length(F.regexp_replace(text, r"[^\[{]", "")) > canon.MAX_DEPTH)
    checked = _strict(F.when(doubtful, text))
    whole = F.when(doubtful, checked).otherwise(text)
    listed = F.try_parse_json(F.concat(F.lit("["), whole, F.lit("]")))
    held = F.try_parse_json(F.concat(F.lit('{"v":'), whole, F.lit("}")))
    held = F.when(F.contains(whole, F.lit("]")), held.isNotNull()).otherwise(listed.isNotNull())
    one = held & F.try_variant_get(listed, "$[1]", "variant").isNull()
    return F.when(one, F.try_variant_get(listed, "$[0]", "variant"))


def snapshots(pages: DataFrame) -> DataFrame:
    """(url, ord, body, snapshot_hash, size) of pages (url, body string or binary[, ord])."""
    binary = dict(pages.dtypes)["body"] == "binary"
    raw = F.col("body") if binary else F.encode("body", "utf-8")
    body = F.when(F.is_valid_utf8(F.col("body")), F.col("body").cast("string")) if binary else F.col("body")
    order = F.col("ord") if "ord" in pages.columns else F.lit(0)
    return pages.select("url", order.cast("long").alias("ord"), body.alias("body"), F.sha2(raw, 256).alias("snapshot_hash"), F.length(raw).alias("size"))


def roots(pages: DataFrame, recipe: Recipe) -> DataFrame:
    """One row per record root, and one with an error per page that fails as a whole."""
    taken = snapshots(pages)
    none = F.lit(None)
    html = recipe.mode in ("html", "browser")
    if html:
        told = taken.withColumn("t", html_roots(recipe)(F.col("body")))
        found, broken = F.col("t.roots"), F.col("t.error")
    else:
        told = taken.withColumn("t", parse_strict(F.col("body")))
        found = paths.json_path(F.col("t"), recipe.scope.value) if recipe.scope.type == "items_path" else F.array("t")
        broken = F.when(F.col("t").isNull(), "SNAPSHOT_INVALID")
    told = told.withColumn("found", found)
    error = (
        F.when(F.col("size") > recipe.limits.max_bytes, "LIMIT_REACHED").when(broken.isNotNull(), broken)
        .when(F.size("found") == 0, "RECORD_SCOPE_EMPTY").when(F.size("found") > recipe.limits.max_records, "LIMIT_REACHED")
    )
    told = told.withColumn("page_error", error)
    return told.select("url", "ord", "snapshot_hash", "page_error", F.posexplode_outer(F.when(F.col("page_error").isNull(), F.col("found")).otherwise(none)).alias("index", "root"))


def _located(recipe: Recipe, k: int, locator) -> Column:
    if recipe.mode in ("html", "browser"):
        return F.transform(F.get(F.col("root"), F.lit(k)), lambda t: F.parse_json(t))
    if locator.type == "json_pointer":
        return F.filter(F.array(paths.pointer_get(F.col("root"), locator.value)), lambda v: v.isNotNull())
    if locator.type == "json_path":
        return paths.json_path(F.col("root"), locator.value)
    blocks = F.filter(paths.json_path(F.col("root"), "$.blocks[*]"), lambda b: F.try_variant_get(b, "$.label", "string") == locator.value)
    return F.filter(F.transform(blocks, lambda b: F.try_variant_get(b, "$.value", "variant")), lambda v: v.isNotNull())


_EVIDENCE = "array<struct<path:string,source_locator:string,locator:string,raw_values:array<string>,transforms:array<string>,outcome:string,error:string>>"


def extract(pages: DataFrame, recipe: Recipe, workspace: str = "default", evidence: bool = True) -> DataFrame:
    """Records of all pages, before identities are merged.

    Columns: record_id, source_id, recipe_hash, snapshot_hash, url, ord, index,
    data (canonical JSON), data_hash, errors (sorted, distinct), evidence. A
    page that fails as a whole has one row with index null and its error code.
    Errors of optional fields stay in the evidence. Null bodies, and texts that
    aren't UTF-8 or strict JSON, are SNAPSHOT_INVALID; no pages give no rows.
    """
    df = roots(pages, recipe)
    fields = sorted(recipe.fields.items())  # evidence order; the data's members are put in canonical order below
    ready, required, proof = {}, [], []
    for k, (pointer, rule) in enumerate(fields):
        raw, state = f"__raw{k}", f"__state{k}"
        df = df.withColumn(raw, _located(recipe, k, rule.locator))
        df = X.run(df, F.col(raw), list(rule.transforms), state, F.col("url"))
        values, failed = F.col(f"{state}.v"), F.col(f"{state}.e")
        error = F.when(F.size(raw) == 0, "LOCATOR_ZERO").when(failed.isNotNull(), failed)
        if rule.cardinality == "one":
            error = error.when(F.size(values) != 1, "LOCATOR_MULTIPLE")
        error = error.when(F.exists(values, F.is_variant_null), "LOCATOR_NULL")
        df = df.withColumn(f"__error{k}", error)
        good = F.col(f"__error{k}").isNull()
        value = F.when(good, F.get(values, F.lit(0))) if rule.cardinality == "one" else F.when(good, values)
        df = df.withColumn(f"__value{k}", value)
        ready[pointer] = F.col(f"__value{k}")
        if rule.required:
            required.append(F.when(~good, F.concat(F.lit(f"{pointer}:"), F.col(f"__error{k}"))))
        if evidence:
            outcome = F.when(~good, "missing").otherwise("derived" if rule.transforms else "observed")
            proof.append(F.struct(
                F.lit(pointer).alias("path"), F.concat(F.lit(f"{recipe.scope.type}:"), F.col("index")).alias("source_locator"),
                F.lit(f"{rule.locator.type} {rule.locator.value}").alias("locator"), F.transform(raw, lambda v: F.to_json(v)).alias("raw_values"),
                F.array(*[F.lit(canon.canonical(t)) for t in rule.transforms]).cast("array<string>").alias("transforms"), outcome.alias("outcome"), F.col(f"__error{k}").alias("error")))
    rooted = F.col("index").isNotNull()
    df = df.withColumn("__json", F.when(rooted, F.to_json(paths.set_pointers(dict(sorted(ready.items(), key=lambda kv: [x.encode("utf-16-be", "surrogatepass") for x in paths.pointer_parts(kv[0])]))))).otherwise("{}"))
    df = _finish(df, recipe, workspace, ready)
    own = F.array_compact(F.array(*required)) if required else F.array().cast("array<string>")
    own = F.concat(own, F.col("__failed"), F.when(F.col("__record_id").isNull(), F.array(F.lit("IDENTITY_MISSING"))).otherwise(F.array().cast("array<string>")))
    errors = F.when(rooted, F.array_sort(F.array_distinct(own))).otherwise(F.array("page_error"))
    # always true, but it keeps filters on errors above this step: pushed down,
    # they would repeat every field's expressions inside the filter
    errors = F.when(F.spark_partition_id() >= 0, errors)
    out = df.select(
        F.when(rooted, F.col("__record_id")).alias("record_id"), F.lit(recipe.source_id).alias("source_id"), F.lit(recipe.hash()).alias("recipe_hash"), "snapshot_hash", "url", "ord", "index",
        F.when(rooted, F.col("__data")).alias("data"), errors.alias("errors"), *([F.array(*proof).cast(_EVIDENCE).alias("evidence")] if evidence else []))
    return out.withColumn("data_hash", F.sha2("data", 256))


def records(extracted: DataFrame) -> DataFrame:
    return extracted.filter(F.size("errors") == 0)


def quarantined(extracted: DataFrame) -> DataFrame:
    return extracted.filter(F.size("errors") > 0)


def merge(extracted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(merged, conflicting) of the valid records, over all pages.

    One identity with one content: one row, the first instance in page order,
    with the number of instances. One identity with several contents: every
    instance is quarantined as IDENTITY_CONFLICT. Evidence of all instances
    stays in ``evidence_rows``; nothing is gathered per identity, so a hot
    identity is only a hot key of a join that spreads it.
    """
    valid = records(extracted)
    first = F.min(F.struct("ord", "url", "index", "snapshot_hash", "data")).alias("first")
    told = valid.groupBy("record_id").agg(F.count("*").alias("instances"), F.min("data_hash").alias("least"), F.max("data_hash").alias("most"), first)
    merged = told.filter("least = most").select(
        "record_id", F.col("first.data").alias("data"), F.col("least").alias("data_hash"), "instances", F.col("first.url").alias("url"), F.col("first.snapshot_hash").alias("snapshot_hash"))
    clash = told.filter("least <> most").select("record_id")
    conflicting = salted_join(valid, clash, "record_id", "left_semi").withColumn("errors", F.array(F.lit("IDENTITY_CONFLICT")))
    return merged, conflicting


def evidence_rows(extracted: DataFrame) -> DataFrame:
    """One row per record instance and field."""
    return extracted.filter("index is not null").select("record_id", "snapshot_hash", "url", "ord", "index", F.explode("evidence").alias("e")).select("record_id", "snapshot_hash", "url", "ord", "index", "e.*")


def semantic_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(record_id, change, before, after) of two record sets (record_id, data, data_hash).

    Records without an id are refused; of a repeated id the greatest hash
    counts, so the result doesn't depend on the order of rows.
    """
    if before.filter("record_id is null").unionByName(after.filter("record_id is null"), allowMissingColumns=True).take(1):
        raise FieldtraceError("IDENTITY_MISSING", "records without an id can't be compared")
    one = lambda d, n: d.groupBy("record_id").agg(F.max(F.struct("data_hash", "data")).alias(n))
    both = one(before, "b").join(one(after, "a"), "record_id", "full")
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(F.col("a.data_hash") != F.col("b.data_hash"), "changed")
    return both.withColumn("change", change).filter("change is not null").select("record_id", "change", F.col("b.data").alias("before"), F.col("a.data").alias("after"))


def result_rows(extracted: DataFrame) -> DataFrame:
    """(url, index, row_hash): a digest of everything that a replay must give again."""
    proof = F.to_json("evidence") if "evidence" in extracted.columns else F.lit("")
    whole = F.concat_ws("\x1f", F.coalesce("record_id", F.lit("")), F.coalesce("data", F.lit("")), F.array_join("errors", ","), proof, "recipe_hash", "snapshot_hash")
    return extracted.select("url", "ord", "index", "snapshot_hash", F.sha2(whole, 256).alias("row_hash"))


def replay(pages: DataFrame, recipe: Recipe, expected: DataFrame, workspace: str = "default") -> DataFrame:
    """Rows that a second run gives differently: (url, ord, index, code)."""
    again = result_rows(extract(pages, recipe, workspace))
    old = expected.select("url", "ord", "index", F.col("snapshot_hash").alias("old_snapshot"), F.col("row_hash").alias("old_hash"))
    keys = [F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")) for c in ("url", "ord", "index")]
    both = again.alias("n").join(old.alias("o"), keys, "full")
    code = F.when(F.col("snapshot_hash").isNull() | F.col("old_snapshot").isNull(), "REPLAY_MISMATCH").when(F.col("snapshot_hash") != F.col("old_snapshot"), "SNAPSHOT_CORRUPT").when(F.col("row_hash") != F.col("old_hash"), "REPLAY_MISMATCH")
    return both.withColumn("code", code).filter("code is not null").select(F.coalesce("n.url", "o.url").alias("url"), F.coalesce("n.ord", "o.ord").alias("ord"), F.coalesce("n.index", "o.index").alias("index"), "code")


def manifest(pages: DataFrame) -> DataFrame:
    """(pages, snapshot_hash): one digest of the ordered page list.

    For one collection: its digests are gathered in order, and ``collect_pages``
    checks the recipe's page limit before.
    """
    listed = snapshots(pages).select("ord", "url", "snapshot_hash")
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "url", "snapshot_hash"))), lambda p: F.concat_ws(" ", p["url"], p["snapshot_hash"])), "\n")
    return listed.agg(F.count("*").alias("pages"), F.sha2(lines, 256).alias("snapshot_hash"))


def manifests(pages: DataFrame, by: str) -> DataFrame:
    """(by, pages, snapshot_hash): the digest of ``manifest`` for every collection at once.

    Each collection's lines reach one task in order and are hashed as they
    pass, so a hot collection costs time there and no memory. Rows without a
    collection name are one collection; pages without an order come last.
    """
    line = F.concat_ws(" ", "url", F.sha2(F.encode("body", "utf-8"), 256))
    listed = pages.select(F.col(by).alias("by"), F.col("ord").cast("long").alias("ord"), line.alias("line"))
    ordered = listed.repartition("by").sortWithinPartitions("by", F.asc_nulls_last("ord"), "line")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, count, digest = None, 0, None
        told = lambda: pd.DataFrame({"by": [name], "pages": [count], "snapshot_hash": [digest.hexdigest()]})
        for f in frames:
            for by_, lines in f.groupby("by", sort=False, dropna=False)["line"]:
                by_ = by_ if isinstance(by_, str) else None
                if digest is None or by_ != name:
                    if digest is not None:
                        yield told()
                    name, count, digest = by_, 0, hashlib.sha256()
                digest.update((("\n" if count else "") + "\n".join(lines)).encode())
                count += len(lines)
        if digest is not None:
            yield told()

    return ordered.select("by", "line").mapInPandas(run, "by string, pages long, snapshot_hash string").withColumnRenamed("by", by)


def collect_pages(pages: DataFrame, recipe: Recipe, workspace: str = "default") -> dict[str, DataFrame]:
    """One collection of pages as a result: merged, quarantined, evidence, summary.

    The collection must have 1 to max_pages pages and at most max_records
    records (LIMIT_REACHED otherwise); within those bounds the summary's
    result_hash covers every record and quarantined row in order.
    """
    count = pages.limit(recipe.limits.max_pages + 1).count()
    if not 1 <= count <= recipe.limits.max_pages:
        raise FieldtraceError("LIMIT_REACHED", f"{count} pages")
    extracted = cut(extract(pages, recipe, workspace))
    if extracted.limit(recipe.limits.max_records + 1).count() > recipe.limits.max_records:
        raise FieldtraceError("LIMIT_REACHED", "records")
    merged, conflicting = merge(extracted)
    bad = quarantined(extracted).unionByName(conflicting)
    lines = lambda df, *c: df.select(F.concat_ws(" ", *c).alias("line")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256).alias("h"))
    good, worse = lines(merged, "record_id", "data_hash"), lines(bad, "snapshot_hash", F.coalesce(F.col("index").cast("string"), F.lit("-")), F.array_join("errors", ","))
    whole = beside(good.select(F.col("n").alias("records"), F.col("h").alias("records_hash")), worse.select(F.col("n").alias("quarantined"), F.col("h").alias("quarantined_hash")), manifest(pages))
    summary = whole.withColumn("result_hash", F.sha2(F.concat_ws(" ", "records_hash", "quarantined_hash", "snapshot_hash", F.lit(recipe.hash())), 256))
    return {"records": merged, "quarantined": bad, "evidence": evidence_rows(extracted), "summary": summary}
