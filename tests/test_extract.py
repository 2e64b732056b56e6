import hashlib
import json
import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from fieldtrace.errors import FieldtraceError
from fieldtrace.functions import canon, dom, paths, transforms as X
from fieldtrace.plans import extract as E
from fieldtrace.plans.recipe import Field, Limits, Locator, Recipe, Scope
from fieldtrace.plans.validate import failures

SCHEMA = {"type": "object", "properties": {"sku": {"type": "string"}, "name": {"type": "string"}, "price": {"type": "number"}}, "required": ["sku", "name"], "additionalProperties": False}


def pointer(p, **kw):
    return Field(Locator("json_pointer", p), **kw)


def catalog(**kw):
    return Recipe("catalog", "json", Scope("items_path", "$.items[*]"), {"/sku": pointer("/sku", required=True), "/name": pointer("/name", required=True), "/price": pointer("/price")}, ("/sku",), SCHEMA, **kw)


def run(spark, recipe, *bodies, kind="string"):
    pages = spark.createDataFrame([(f"https://e.example/{k}", k, b) for k, b in enumerate(bodies)], f"url string, ord long, body {kind}")
    return E.extract(pages, recipe)


def rows(df):
    return [(json.loads(r["data"]) if r["data"] else None, list(r["errors"])) for r in df.orderBy("ord", "index").collect()]


GOOD = '{"items":[{"sku":"A","name":"Cordless drill","price":42},{"sku":"B","name":"Anchor adhesive","price":18}]}'


def test_records_ids_and_replay(spark):
    df = run(spark, catalog(), GOOD)
    got = df.orderBy("index").collect()
    assert [json.loads(r["data"])["sku"] for r in got] == ["A", "B"]
    assert got[0]["data"] == '{"name":"Cordless drill","price":42,"sku":"A"}'
    assert got[0]["record_id"] == canon.object_hash(["default", "catalog", ["A"]])
    pages = spark.createDataFrame([("https://e.example/0", 0, GOOD)], "url string, ord long, body string")
    kept = E.result_rows(df)
    assert E.replay(pages, catalog(), kept).count() == 0
    other = pages.withColumn("body", F.replace("body", F.lit("42"), F.lit("43")))
    assert {r["code"] for r in E.replay(other, catalog(), kept).collect()} == {"SNAPSHOT_CORRUPT"}


def test_quarantine_null_missing_and_evidence(spark):
    df = run(spark, catalog(), '{"items":[{"sku":"A"},{"sku":"B","name":null},{"sku":"","name":"x"},{"sku":"C","name":"y"},{"sku":"D","name":"z","price":"9"}]}')
    assert [e for _, e in rows(df)] == [["/:VALIDATION_FAILED", "/name:LOCATOR_ZERO"], ["/:VALIDATION_FAILED", "/name:LOCATOR_NULL"], ["IDENTITY_MISSING"], [], ["/price:VALIDATION_FAILED"]]
    proof = {(r["index"], r["path"]): (r["outcome"], r["error"], r["raw_values"]) for r in E.evidence_rows(df).collect()}
    assert proof[1, "/name"] == ("missing", "LOCATOR_NULL", ["null"])
    assert proof[3, "/price"] == ("missing", "LOCATOR_ZERO", [])
    assert proof[3, "/sku"] == ("observed", None, ['"C"'])


def test_page_errors(spark):
    df = run(spark, catalog(limits=Limits(max_records=2, max_bytes=200)), "not json", '{"items":[]}', '{"items":[1,2,3]}', None, '{"a":1,"a":2}', '{"items":[1e999]}', '{"x":"' + "y" * 300 + '"}', "[" * 40 + "]" * 40)
    assert [e for _, e in rows(df)] == [["SNAPSHOT_INVALID"], ["RECORD_SCOPE_EMPTY"], ["LIMIT_REACHED"], ["SNAPSHOT_INVALID"], ["SNAPSHOT_INVALID"], ["SNAPSHOT_INVALID"], ["LIMIT_REACHED"], ["SNAPSHOT_INVALID"]]
    binary = run(spark, catalog(), b"\xff", GOOD.encode(), kind="binary")
    assert [e for _, e in rows(binary)] == [["SNAPSHOT_INVALID"], [], []]
    assert run(spark, catalog(), GOOD).limit(0).count() == 0


def test_merge_and_conflict(spark):
    same, other = '{"items":[{"sku":"A","name":"X"}]}', '{"items":[{"sku":"A","name":"Y"},{"sku":"B","name":"Z"}]}'
    merged, clash = E.merge(run(spark, catalog(), same, same))
    assert [(r["instances"], r["url"]) for r in merged.collect()] == [(2, "https://e.example/0")] and clash.count() == 0
    merged, clash = E.merge(run(spark, catalog(), same, other))
    assert [json.loads(r["data"])["sku"] for r in merged.collect()] == ["B"]
    assert [list(r["errors"]) for r in clash.collect()] == [["IDENTITY_CONFLICT"]] * 2


def test_collection(spark):
    pages = spark.createDataFrame([("u1", 0, GOOD), ("u2", 1, '{"items":[{"sku":"A","name":"Other"},{"sku":"Q"}]}')], "url string, ord long, body string")
    one, two = (E.collect_pages(p, catalog()) for p in (pages, pages.repartition(3)))
    s = one["summary"].first()
    assert (s["pages"], s["records"], s["quarantined"]) == (2, 1, 3) and s["result_hash"] == two["summary"].first()["result_hash"]
    assert one["evidence"].count() == 12 and sorted(e for r in one["quarantined"].collect() for e in r["errors"]) == ["/:VALIDATION_FAILED", "/name:LOCATOR_ZERO", "IDENTITY_CONFLICT", "IDENTITY_CONFLICT"]
    for bad in (pages.limit(0), pages):
        with pytest.raises(FieldtraceError):
            E.collect_pages(bad, catalog(limits=Limits(max_pages=1)))


def test_manifests_cover_every_collection(spark):
    rows = [(name, f"https://e.example/{name}/{k}", k, f"ü{k}") for name, n in (("hot", 25_000), ("b", 2), ("c", 1), (None, 3)) for k in range(n)]
    pages = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "source string, url string, ord long, body string")
    got = {r["source"]: (r["pages"], r["snapshot_hash"]) for r in E.manifests(pages, "source").collect()}
    want = {}
    for name in ("hot", "b", "c", None):
        lines = [f"{u} {hashlib.sha256(b.encode()).hexdigest()}" for s, u, _, b in rows if s == name]
        want[name] = (len(lines), hashlib.sha256("\n".join(lines).encode()).hexdigest())
    assert got == want
    assert got["b"] == tuple(E.manifest(pages.filter("source = 'b'")).first())
    assert E.manifests(pages.limit(0), "source").count() == 0


def test_every_source_has_a_manifest(spark):
    from fieldtrace.queries import extraction

    d = "/root/testdata/sf0.001"
    got = {r["source"]: (r["pages"], r["manifest"]) for r in extraction.manifest_hashes(spark, d).collect()}
    assert got.keys() == {r["source"] for r in spark.read.parquet(f"{d}/documents.parquet").select("source").distinct().collect()}
    assert all(got[r["source"]] == (r["pages"], r["manifest"]) for r in extraction.manifest_hash(spark, d).collect())


def test_both_ways_of_finishing_agree(spark):
    tricky = ['{"sku":"A","name":"plain","price":5}', '{"sku":"\\u0041\\n","name":"q\\"x","price":5.0}', '{"sku":"B","name":"{x}","price":1e3}', '{"sku":"C","name":"d","price":12345678901234567890}', '{"sku":"E","name":"long enough text here","price":-1}', '{"sku":"F","name":"f","price":true}']
    flat = {"type": "object", "properties": {"sku": {"type": "string"}, "name": {"type": "string", "maxLength": 12}, "price": {"type": "number", "minimum": 0}}, "required": ["sku", "name"]}
    base = Recipe("c", "json", Scope("one_per_resource"), catalog().fields, ("/sku",), flat)
    deep = Recipe("c", "json", Scope("one_per_resource"), catalog().fields, ("/sku",), flat | {"minProperties": 0})
    a, b = ([(r["record_id"], r["data"], list(r["errors"])) for r in run(spark, recipe, *tricky).orderBy("ord").collect()] for recipe in (base, deep))
    assert a == b
    assert [e for _, _, e in a] == [[], [], [], ["/:VALIDATION_FAILED", "IDENTITY_MISSING"], ["/name:VALIDATION_FAILED", "/price:VALIDATION_FAILED"], ["/price:VALIDATION_FAILED"]]


def test_diff(spark):
    before, after = (E.records(run(spark, catalog(), b)) for b in (GOOD, '{"items":[{"sku":"A","name":"Drill"},{"sku":"C","name":"New"}]}'))
    assert sorted(r["change"] for r in E.semantic_diff(before, after).collect()) == ["added", "changed", "removed"]
    with pytest.raises(FieldtraceError):
        E.semantic_diff(before.withColumn("record_id", F.lit(None).cast("string")), after)


def test_html_scope_attributes_and_jsonld(spark):
    recipe = Recipe("shop", "html", Scope("container_selector", "div.item"), {
        "/sku": Field(Locator("css_attr", "[data-sku]", "data-sku"), required=True), "/name": Field(Locator("css_text", "h2 > b, h2.t"), transforms=({"op": "collapse_whitespace"},), required=True),
        "/link": Field(Locator("css_attr", "a", "href"), transforms=({"op": "resolve_url"},)), "/tags": Field(Locator("css_attr", "p", "class"), "many")}, ("/sku",))
    html = '<div class="item x"><span data-sku="A"></span><h2><b> Drill &amp; Co\n</b></h2><a href="/d?x=1">d</a><p class="u v">.</div><div class=item><i data-sku=B></i><h2 class="t">Saw<br>blade</h2><script>var t="</p>"</script></div>'
    assert rows(run(spark, recipe, html)) == [({"sku": "A", "name": "Drill & Co", "link": "https://e.example/d?x=1", "tags": [["u", "v"]]}, []), ({"sku": "B", "name": "Saw blade"}, [])]
    assert rows(run(spark, recipe, '<div class="item"><div class="item"></div></div>')) == [(None, ["RECORD_SCOPE_OVERLAP"])]
    ld = Recipe("ld", "html", Scope("one_per_resource"), {"/n": Field(Locator("jsonld", "name"), "many", required=True)}, ("/n",))
    page = '<script type="application/ld+json">{"name":"a","@graph":[{"name":"b","@graph":[{"name":"c"}]}]}</script><script type="application/ld+json">{bad</script><script type="application/ld+json">[{"name":"d"},1]</script>'
    assert rows(run(spark, ld, page)) == [({"n": ["a", "b", "c", "d"]}, [])]


def test_blocks(spark):
    recipe = Recipe("doc", "pdf", Scope("one_per_document"), {"/sku": Field(Locator("labeled_value", "SKU"), required=True), "/w": Field(Locator("labeled_value", "Weight"), "many")}, ("/sku",))
    body = '{"blocks":[{"label":"SKU","value":"A","page":1},{"label":"Weight","value":5},{"label":"Weight","value":"6 kg"},{"label":"Weight"},{"value":1}]}'
    assert rows(run(spark, recipe, body)) == [({"sku": "A", "w": [5, "6 kg"]}, [])]


@pytest.mark.parametrize("bad", ["$..a", "$[?(@.x)]", "$.x.length()", "x", "$.__class__()"])
def test_json_path_refusals(bad):
    with pytest.raises(FieldtraceError):
        paths.json_path(F.lit(None), bad)


def test_recipe_refusals():
    for change in ({"identity": ("/price",)}, {"identity": ()}, {"mode": "html"}, {"fields": {"/a": pointer("/a", required=True), "/a/b": pointer("/b")}, "identity": ("/a",)}, {"scope": Scope("items_path")}, {"source_id": "a b"}):
        base = {"source_id": "c", "mode": "json", "scope": Scope("items_path", "$"), "fields": {"/sku": pointer("/s", required=True), "/price": pointer("/p")}, "identity": ("/sku",)}
        with pytest.raises(FieldtraceError):
            Recipe(**(base | change))
    with pytest.raises(FieldtraceError):
        pointer("/a", transforms=({"op": "regex_capture", "pattern": "(?=a)"},)) and catalog().with_fields(**{"/x": pointer("/a", transforms=({"op": "regex_capture", "pattern": "(?=a)"},))})


CASES = [
    (["1.234,5"], {"op": "parse_decimal", "decimal_separator": ",", "grouping_separator": "."}, [1234.5], None),
    (["NaN"], {"op": "parse_decimal", "decimal_separator": "."}, None, "TRANSFORM_PARSE"), (["1e400"], {"op": "parse_decimal", "decimal_separator": "."}, None, "TRANSFORM_PARSE"), (["1_0"], {"op": "parse_decimal", "decimal_separator": "."}, [10], None),
    (["\x1c a b  "], {"op": "strip"}, ["a b"], None), (["a \n b"], {"op": "collapse_whitespace"}, ["a b"], None), (["é"], {"op": "unicode_nfc"}, ["é"], None),
    (["a", "b"], {"op": "join", "separator": "-"}, ["a-b"], None), (["a", 1], {"op": "join", "separator": "-"}, None, "TRANSFORM_TYPE"), (["A", "A B", "A"], {"op": "unique"}, ["A B", "A"], None), ([10, 9, "x"], {"op": "sort"}, ["x", 10, 9], None),
    ([True, None, "q"], {"op": "enum_map", "mapping": {"True": "yes", "None": "no"}, "unknown": "keep"}, ["yes", "no", "q"], None), (["q"], {"op": "enum_map", "mapping": {"a": "b"}, "unknown": "null"}, [None], None), (["q"], {"op": "enum_map", "mapping": {"a": "b"}}, None, "TRANSFORM_PARSE"),
    (["ab12"], {"op": "regex_capture", "pattern": r"(?P<n>\d+)", "group": "n"}, ["12"], None), (["ab"], {"op": "regex_capture", "pattern": r"(\d+)"}, None, "TRANSFORM_PARSE"), (["a", "ab"], {"op": "regex_capture", "pattern": "a(b)?"}, [None, "b"], None), (["a", "c"], {"op": "regex_capture", "pattern": "a(b)?|x(y)"}, None, "TRANSFORM_PARSE"), ([5], {"op": "strip"}, None, "TRANSFORM_TYPE"),
    (["2024-1-5"], {"op": "parse_date", "format": "%Y-%m-%d"}, ["2024-01-05T00:00:00+00:00"], None), (["20240105"], {"op": "parse_date", "format": "%Y%m%d"}, ["2024-01-05T00:00:00+00:00"], None), (["x"], {"op": "parse_date", "format": "%d %b %Y"}, None, "TRANSFORM_PARSE"),
    (["../x"], {"op": "resolve_url"}, ["https://e.example/x"], None),
]


def test_transforms(spark):
    for values, rule, want, code in CASES:
        df = spark.createDataFrame([(json.dumps(values),)], "t string").withColumn("v", F.parse_json("t"))
        got = X.run(df, paths.elements(F.col("v")), [rule], "s", F.lit("https://e.example/a/b")).select(F.to_json("s.v"), "s.e").first()
        assert (None if got[1] else json.loads(got[0]), got[1]) == (want, code), rule


def test_null_elements_are_json_nulls(spark):
    df = spark.createDataFrame([(["b", None, "a"],)], "x array<string>").withColumn("v", F.transform("x", lambda x: x.cast("variant")))
    for op, want in (("sort", ["a", "b", None]), ("unique", ["a", "b", None])):
        assert json.loads(X.run(df, F.col("v"), [{"op": op}], "s").select(F.to_json("s.v")).first()[0]) == want


names = st.text(st.characters(blacklist_categories=["Cs"]), max_size=6)


@settings(max_examples=50, deadline=None)
@given(st.lists(names, min_size=1, max_size=4))
def test_pointer_round_trip(parts):
    assert paths.pointer_parts("/" + "/".join(p.replace("~", "~0").replace("/", "~1") for p in parts)) == parts


@settings(max_examples=100, deadline=None)
@given(st.floats(allow_nan=False, allow_infinity=False))
def test_numbers_round_trip(x):
    assert float(canon.number_text(x)) == x


def test_number_forms():
    want = {1e21: "1e+21", 1e20: "100000000000000000000", 0.000001: "0.000001", 1e-7: "1e-7", -0.0: "0", 42.0: "42", 123.456: "123.456", 5e-324: "5e-324", 1.5e300: "1.5e+300", 0.1: "0.1", 100.0: "100"}
    assert {k: canon.number_text(k) for k in want} == want
    assert canon.canonical({"b": 1, "a": [True, None, "€\n"], "": 1, "\U0001f600": 2}) == '{"a":[true,null,"€\\n"],"b":1,"\U0001f600":2,"":1}'


def test_strict_json_and_schema():
    for bad in ("NaN", "Infinity", "1e999", '{"a":1,"a":2}', "[" * 100 + "]" * 100):
        with pytest.raises(ValueError):
            canon.loads_strict(bad)
    assert sorted(failures({"sku": 1, "x": 2}, SCHEMA)) == ["/", "/", "/sku"]
    assert list(failures({"sku": "a", "name": "b", "price": 1}, SCHEMA)) == []


def test_selectors():
    tree = dom.parse('<ul id=a><li class="x y">1<li>2</ul><p title="q r">3</p>')
    pick = lambda s: [n.text("").strip() for n in dom.select(tree, s)]
    assert pick("#a > li.x") == ["12"] and pick("p[title~=r], ul") == ["12", "3"] and pick("[title$='r']") == ["3"]
    for bad in ("a:hover", "> a", "a >", "", "a[", "a,,b"):
        with pytest.raises(FieldtraceError):
            dom.compile_selector(bad)
