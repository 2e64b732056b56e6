import datetime
import json
import os

import pytest
from pyspark.sql import functions as F

from fieldtrace.errors import FieldtraceError
from fieldtrace.functions import text
from fieldtrace.operators import audit, classify, control, evaluate as V, frontier, taxonomy as T
from fieldtrace.plans import legacy, propose
from fieldtrace.plans.extract import extract, records
from fieldtrace.sources import artifacts as S
from fieldtrace.sources.fetch import captured_pages, follow


# frontier
@pytest.mark.parametrize("address", ["127.0.0.1", "10.1.2.3", "169.254.1.1", "224.0.0.1", "::1", "fe80::1", "::ffff:10.0.0.1", "2002:0a00:0001::", "2001:0000:4136:e378:8000:63bf:3fff:fdd2", "64:ff9b::a00:1", "64:ff9b:1::1", "x", ""])
def test_addresses_denied(address):
    assert not frontier.is_public(address)


def test_addresses_and_policy(spark):
    assert frontier.is_public("93.184.216.34") and frontier.is_public("2606:4700::1111")
    cases = {"https://a.example/x": None, "HTTP://A.EXAMPLE:80/": None, "ftp://a.example/": "URL_POLICY_DENIED", "https://u:p@a.example/": "URL_POLICY_DENIED", "https://a.example/#f": "URL_POLICY_DENIED", "https://a.example/?Api_Key=1": "URL_POLICY_DENIED",
             "https://b.example/": "DOMAIN_DENIED", "https://a.example:8080/": "PORT_DENIED", "nonsense": "URL_POLICY_DENIED", "": "URL_POLICY_DENIED"}
    df = spark.createDataFrame([(u,) for u in cases] + [(None,)], "u string")
    got = {r["u"]: r["c"] for r in df.select("u", frontier.url_policy(F.col("u"), ["a.example"]).alias("c")).collect()}
    assert got == cases | {None: "URL_POLICY_DENIED"}


def test_robots(spark):
    rules = "User-agent: *\nDisallow: /private\nCrawl-delay: 3\nRequest-rate: 1/10"
    df = spark.createDataFrame([(rules, "https://a.example/private/x"), (rules, "https://a.example/y"), (None, "https://a.example/private"), (rules, None)], "r string, u string")
    got = [tuple(r[0]) for r in df.select(frontier.robots_rule("r", F.lit("bot"), "u")).collect()]
    assert got == [(False, 10.0), (True, 10.0), (True, None), (False, None)]


def test_crawl_order_limit_and_loops(spark):
    links = spark.createDataFrame([("a", 0, "c"), ("a", 1, "b"), ("a", 2, "c"), ("b", 0, "d"), ("c", 0, "a"), ("c", 1, "e"), ("d", 0, None)], "url string, ord int, target string")
    seeds = spark.createDataFrame([("a", 0), ("a", 1), (None, 2)], "url string, ord int")
    got = [r["url"] for r in frontier.crawl_waves(links, seeds, 100).orderBy("position").collect()]
    assert got == ["a", "c", "b", "e", "d"]
    with pytest.raises(FieldtraceError, match="LIMIT_REACHED"):  # never a part of the pages
        frontier.crawl_waves(links, seeds, 3)
    assert frontier.crawl_waves(links, seeds.limit(0), 5).count() == 0


def test_link_discovery(spark):
    rows = [("https://a.example/p/", '["x", ["/y", ""], null, 5]'), ("https://a.example/", '["http://a.example/z", "https://b.example/", "z#f"]'), ("https://a.example/e", "[]")]
    df = spark.createDataFrame(rows, "url string, t string").select("url", F.try_variant_get(F.parse_json("t"), "$", "array<variant>").alias("values"))
    got = [(r["target"], r["error"]) for r in frontier.discover(df, ["a.example"]).orderBy(F.desc("url"), "ord").collect()]
    assert got == [("https://a.example/p/x", None), ("https://a.example/y", None), (None, "NAVIGATION_INVALID"), (None, "URL_POLICY_DENIED"), (None, "DOMAIN_DENIED"), (None, "URL_POLICY_DENIED")]
    one = [(r["url"], r["target"], r["error"]) for r in frontier.discover(df, ["a.example"], next_only=True).collect()]
    assert ("https://a.example/p/", None, "NAVIGATION_AMBIGUOUS") in one and len(one) == 2


# folds
def test_folds(spark):
    writes = spark.createDataFrame([("a", 1, 0), ("a", 2, 5), ("a", 3, 1), ("b", 1, 1), (None, 1, 0)], "key string, seq int, expected_version int")
    assert sorted((r["key"], r["seq"], r["accepted"]) for r in control.version_chain(writes).collect()) == [("a", 1, True), ("a", 2, False), ("a", 3, True), ("b", 1, False)]
    puts = spark.createDataFrame([("a", 1, 60, 100), ("a", 2, 50, 100), ("a", 3, 40, 100)], "key string, seq int, size int, limit int")
    assert [r["accepted"] for r in control.quota(puts).orderBy("seq").collect()] == [True, False, True]
    req = spark.createDataFrame([("k", 1, "h"), ("k", 2, "h"), ("k", 3, "g"), (None, 4, "h"), ("n", 5, None), ("n", 6, None)], "key string, seq int, request_hash string")
    assert [r["outcome"] for r in control.idempotency(req).orderBy("seq").collect()] == ["stored", "replayed", "conflict", "stored", "stored", "replayed"]
    slots = spark.createDataFrame([("o", 1, 0.0), ("o", 2, 1.0), ("o", 3, 50.0)], "origin string, seq int, at double")
    assert [r["planned"] for r in control.slots(slots, F.lit(10)).orderBy("seq").collect()] == [0.0, 10.0, 50.0]
    acts = spark.createDataFrame([("s", 1, "r1"), ("s", 2, "r2"), ("t", 1, "r3")], "source string, seq int, item string")
    assert {(r["item"], r["state"]) for r in control.supersession(acts).collect()} == {("r1", "superseded"), ("r2", "active"), ("r3", "active")}


def test_pages_and_due(spark):
    rows = spark.range(10).withColumnRenamed("id", "k")
    assert [r["k"] for r in control.page(rows, "k", None, 3).collect()] == [0, 1, 2]
    assert [r["k"] for r in control.page(rows, "k", 8, 3).collect()] == [9]
    with pytest.raises(FieldtraceError):
        control.page(rows, "k", None, 0)
    two = rows.withColumn("d", F.col("k") % 3)
    assert [(r["d"], r["k"]) for r in control.page_desc(two, "d", "k", (2, 5), 3).collect()] == [(2, 2), (1, 7), (1, 4)]
    now = datetime.datetime(2024, 1, 1, 1)
    df = spark.createDataFrame([(1, datetime.datetime(2024, 1, 1, 0), 600), (2, datetime.datetime(2024, 1, 1, 2), 600)], "id int, next_due timestamp, interval_s int")
    got = control.due(df, F.lit(now), 5).collect()
    assert [(r["id"], r["missed"], r["next_due"]) for r in got] == [(1, 6, datetime.datetime(2024, 1, 1, 1, 10))]


# evaluation
def test_evaluation(spark):
    df = spark.createDataFrame([("a", {"a": 0.9, "b": 0.1}), ("b", {"a": 0.6, "b": 0.4}), ("b", {"a": 0.5, "b": 0.5})], "label string, probabilities map<string,double>")
    j = V.judged(df)
    assert [r["chosen"] for r in j.collect()] == ["a", "a", "a"]
    assert {r["class"]: (r["tp"], r["fp"], r["fn"]) for r in V.confusion(j).collect()} == {"a": (1, 2, 0), "b": (0, 0, 2)}
    assert V.macro_f1(V.confusion(j)).first()[0] == pytest.approx(0.25)
    assert V.brier(j).first()[0] == pytest.approx((0.02 + 0.72 + 0.5) / 3)
    assert V.expected_calibration_error(j).first()[0] == pytest.approx((0.1 + 0.6 + 0.5) / 3)
    assert V.fit_temperature(df).first()["temperature"] in V.TEMPERATURES
    w = spark.createDataFrame([(100, 100), (0, 0), (50, 100)], "c int, n int").select(V.wilson_lower(F.col("c"), F.col("n")).alias("w")).collect()
    assert w[0][0] > 0.95 and w[1][0] == 0 and 0.40 < w[2][0] < 0.41
    bad = spark.createDataFrame([({"a": 0.5},), ({"a": 1.0},), ({"a": float("nan"), "b": 1.0},), ({"a": 1.5, "b": -0.5},)], "p map<string,double>")
    assert [r[0] for r in bad.select(V.valid_probabilities(F.col("p"))).collect()] == [False, True, False, False]
    arrays = spark.createDataFrame([(["r", "a", "x"], ["r", "a", "y", "z"]), (["q"], ["r"]), ([], ["r"])], "a array<string>, b array<string>")
    assert [r[0] for r in arrays.select(V.shared_prefix(F.col("a"), F.col("b"))).collect()] == [2, 0, 0]


# taxonomy, audit, classifier
def test_ranking(spark):
    leaf = spark.createDataFrame([(1, "Drill power tools"), (2, "Saw power tools"), (3, "")], "leaf_id int, text string")
    q = spark.createDataFrame([(10, "a POWER drill"), (11, "saw"), (12, "nothing here"), (13, None)], "q int, t string")
    told = lambda limit, fill: {(r["q"], r["leaf_id"], r["rank"]) for r in T.rank(q, "q", "t", leaf, limit, fill).collect()}
    assert told(1, False) == {(10, 1, 1), (11, 2, 1)}
    assert told(1, True) == {(10, 1, 1), (11, 2, 1), (12, 1, 1), (13, 1, 1)}
    assert told(5, True) == {(10, 1, 1), (10, 2, 2), (10, 3, 3), (11, 2, 1), (11, 1, 2), (11, 3, 3), (12, 1, 1), (12, 2, 2), (12, 3, 3), (13, 1, 1), (13, 2, 2), (13, 3, 3)}
    assert T.rank(q, "q", "t", leaf.limit(0), 5).count() == 0


def test_audit(spark):
    nodes = spark.createDataFrame([(1, None, "1"), (2, 1, "1.2")], "id long, parent_id long, path string")
    cols = "listing_id long, brand string, product_name string, type_id string, classification_path string, short_description string, long_description string, source_url string"
    df = spark.createDataFrame([
        (1, "b", "Drill X", "2", "1.2", "s", None, "https://a.example/1"), (2, "b", "drill  x", "1", "1", None, "l", "https://a.example/2"), (3, "c", "Saw", "9", None, None, None, "x"),
        (4, None, None, None, None, "s", "l", None), (5, "d", "Axe", "2", "1.9", "s", None, "https://a.example/1")], cols)
    got = {r["listing_id"]: list(r["issues"]) for r in audit.flags(df, nodes).collect()}
    assert got == {
        1: ["duplicate_brand_product_name", "duplicate_source_url"], 2: ["duplicate_brand_product_name", "predicted_id_is_not_leaf"], 3: ["invalid_source_url", "missing_name_or_description", "unknown_or_missing_predicted_id"],
        4: ["invalid_source_url", "missing_name_or_description", "unknown_or_missing_predicted_id"], 5: ["duplicate_source_url", "predicted_path_mismatch"]}
    assert audit.flags(df.limit(0), nodes).count() == 0


def test_classifier_held_out(spark):
    rows = [("drill" if k % 2 else "paint", f"{'hammer drill bit' if k % 2 else 'wall paint white'} {k % 7}") for k in range(80)]
    df = spark.createDataFrame([*rows, (None, "x")], "label string, t string")
    model = classify.fit(df, "t", "label", 5)
    test = spark.createDataFrame([("drill", "new drill bit"), ("paint", "white wall colour"), ("other", None)], "label string, t string")
    assert [r["chosen"] for r in classify.predict(model, test, "t").collect()][:2] == ["drill", "paint"]


# legacy and text
def test_fan_out_and_spec_map(spark):
    df = spark.createDataFrame([(1, [{"Size": "L", "Order number": "7"}, {"Weight": "1"}], {"Size": "M"}, "m-1", "https://a.example/p/tail/"), (2, None, None, "", "https://a.example/p/tail/?x=1")], "id int, v array<map<string,string>>, specs map<string,string>, model_article_number string, source_url string")
    got = [(r["id"], r["variant_no"], r["specs"], r["order_number"]) for r in legacy.fan_out(df, "v", "specs").orderBy("id", "variant_no").collect()]
    assert got == [(1, 0, {"Size": "L", "Order number": "7"}, "7"), (1, 1, {"Size": "M", "Weight": "1"}, "m-1"), (2, None, {}, "tail")]
    m = spark.createDataFrame([(["a", "b", "a"], ["1", "2", "3"]), (["a", "b"], ["1"]), ([], [])], "k array<string>, v array<string>").select(legacy.spec_map(F.col("k"), F.col("v"))).collect()
    assert [r[0] for r in m] == [{"b": "2", "a": "3"}, {"a": "1"}, {}]


def test_text_functions(spark):
    df = spark.createDataFrame([("Grüße Straße ΣΊΓΜΑΣ a_b", "https://x.example/a/b/?q#f", 'Answer: {"id": 3} ok'), (None, None, None)], "t string, u string, r string")
    got = df.select(text.word_list(F.col("t")), text.bare_url(F.col("u")), F.try_variant_get(text.reply_json(F.col("r")), "$.id", "int")).collect()
    assert tuple(got[0]) == (["grüsse", "strasse", "σίγμασ", "a_b"], "https://x.example/a/b", 3) and tuple(got[1]) == (None, None, None)


# proposals
SCHEMA = {"type": "object", "properties": {"product_name": {"type": "string"}, "sku": {"type": "string"}, "price": {"type": "number"}, "tags": {"type": "array", "items": {"type": "string"}}}, "required": ["sku", "product_name"]}


def test_proposals(spark):
    body = '{"items":[{"productName":"Drill","SKU":"A","cost":5,"tags":["x","y"]}]}'
    made = propose.propose(body, "json", SCHEMA, "src", ("/sku",))
    assert made.unmapped == () and "/price" not in made.recipe.fields
    pages = spark.createDataFrame([("https://a.example", body)], "url string, body string")
    assert json.loads(records(extract(pages, made.recipe)).first()["data"]) == {"product_name": "Drill", "sku": "A", "tags": ["x", "y"]}
    html = '<h1>Drill</h1><span itemprop="sku"> A </span><b data-field="price">5.5</b>'
    plain = {"type": "object", "properties": {"name": {"type": "string"}, "sku": {"type": "string"}, "price": {"type": "number"}}, "required": ["sku"]}
    made = propose.propose(html, "html", plain, "src", ("/sku",))
    assert json.loads(records(extract(spark.createDataFrame([("u", html)], "url string, body string"), made.recipe)).first()["data"]) == {"name": "Drill", "sku": "A", "price": 5.5}
    assert propose.propose('{"a":1}', "json", plain, "src", ("/sku",)).unmapped == ("/sku",)
    with pytest.raises(FieldtraceError):
        propose.schema_leaves({"type": "object", "properties": {"a": {"anyOf": []}}})


# artifacts, manifests, captured pages
def test_artifacts(spark, tmp_path):
    store = f"file://{tmp_path}/store"
    df = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "body string")
    assert S.put(df, store).count() == 2 and S.put(df, store).count() == 0
    key = spark.read.parquet(store).filter("cast(body as string) = 'a'").first()["key"]
    assert S.get(spark, store, key) == b"a" and S.verify(spark, store).count() == 0
    spark.createDataFrame([("0" * 64, bytearray(b"x")), ("zz", bytearray(b"x"))], "key string, body binary").write.mode("append").parquet(store)
    assert {r["problem"] for r in S.verify(spark, store).collect()} == {"ARTIFACT_CORRUPT", "INVALID_KEY"}
    for k, code in (("0" * 64, "ARTIFACT_CORRUPT"), ("1" * 64, "REPLAY_UNAVAILABLE"), ("x", "REPLAY_UNAVAILABLE")):
        with pytest.raises(FieldtraceError) as e:
            S.get(spark, store, k)
        assert e.value.code == code


def test_publication(spark, tmp_path):
    folder = f"file://{tmp_path}/head"
    assert S.head(spark, folder) is None
    assert S.publish(spark, folder, 0, {"n": 1}) == 1 and S.publish(spark, folder, 1, {"n": 2}) == 2
    for expected, code in ((0, "PUBLICATION_CONFLICT"), (1, "PUBLICATION_CONFLICT"), (7, "STALE_VERSION")):
        with pytest.raises(FieldtraceError) as e:
            S.publish(spark, folder, expected, {})
        assert e.value.code == code
    assert S.head(spark, folder) == (2, {"n": 2})


def test_schema_file(tmp_path):
    path = str(tmp_path / "s.json")
    assert not S.write_schema(path, SCHEMA, check=True) and S.write_schema(path, SCHEMA) and S.write_schema(path, SCHEMA, check=True)
    assert not S.write_schema(path, {"type": "object"}, check=True)


def test_csv_with_mark_and_pinned_digest(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_bytes('﻿id,name\n1,"a ""q""\nb"\n'.encode())
    assert [tuple(r) for r in S.read_csv(spark, str(path)).collect()] == [("1", 'a "q"\nb')]
    with pytest.raises(FieldtraceError):
        S.read_pinned(spark, str(path), "0" * 64)


def test_sitemap_and_mime(spark):
    xml = '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>https://a.example/?a=1&amp;b=2</loc></url><url><loc>x</loc></url></urlset>'
    assert spark.createDataFrame([(xml,)], "x string").select(S.sitemap_urls(F.col("x"))).first()[0] == ["https://a.example/?a=1&b=2", "x"]
    df = spark.createDataFrame([("html", "Text/HTML; charset=x"), ("json", "text/json"), ("json", "text/html"), ("html", None)], "m string, t string")
    assert [r[0] for r in df.select(S.mime_allowed(F.col("m"), F.col("t"))).collect()] == [True, True, False, False]


def test_redirects_across_files(spark, tmp_path):
    files = {
        "a": [{"url": "https://a.example/1", "location": "https://a.example/2"}, {"url": "https://a.example/3", "location": "http://a.example/4"}, {"url": "https://a.example/5", "location": "https://a.example/5"}, {"url": "https://a.example/6", "body": "y" * 50}, {"url": "https://a.example/8", "location": "https://gone.example/"}],
        "b": [{"url": "https://a.example/2", "location": "https://a.example/7"}, {"url": "http://a.example/4", "body": "x"}], "c": [{"url": "https://a.example/7", "body": "hi", "content_type": "text/html", "status": 200}, {"body": "no url"}]}
    for name, rows in files.items():
        with open(os.path.join(tmp_path, f"{name}.jsonl"), "w") as f:
            f.writelines(json.dumps(r) + "\n" for r in rows)
    got = {r["request_url"]: (r["url"], r["error"], r["body"] and bytes(r["body"])) for r in follow(captured_pages(spark, str(tmp_path)), max_bytes=20).collect()}
    assert len(got) == 8 and got["https://a.example/1"] == ("https://a.example/7", None, b"hi") == got["https://a.example/2"]
    assert [got[f"https://a.example/{k}"][1:] for k in (3, 5, 6, 8)] == [("URL_POLICY_DENIED", None), ("URL_POLICY_DENIED", None), ("LIMIT_REACHED", None), ("URL_POLICY_DENIED", None)]
    assert follow(captured_pages(spark, str(tmp_path)).limit(0)).count() == 0


def test_whole_prompt(spark, tmp_path):
    from fieldtrace.queries import taxonomy

    specs = {f"k{9 - i if i < 10 else 'last'}": [f"v{i}", "ü"] if i == 1 else f"v{i}" for i in range(11)}
    long = "sealing " + "x" * 200 + " end"
    rows = [(1, "Tile glue", long, json.dumps(specs)), (2, "Glue", None, "not json"), (3, None, None, None), (4, "nothing", "", "[1]")]
    spark.createDataFrame(rows, "listing_id long, product_name string, short_description string, technical_specs string").write.parquet(f"{tmp_path}/products.parquet")
    leaves = [(100 + k, f"Glue {k}", "subcategory", "1", []) for k in range(35)]
    spark.createDataFrame([(1, "Chemistry", "category", None, []), *leaves], "canon_id int, name string, level string, parent_canon_id string, aliases array<string>").write.parquet(f"{tmp_path}/canonical_categories.parquet")
    got = {r["listing_id"]: r["context"].split("\n") for r in taxonomy.prompt_whole(spark, str(tmp_path)).collect()}
    head = "MOST RELEVANT CLASSIFICATION OPTIONS:"
    assert got[1][:2] == ["Name: Tile glue", f"Description: {long}"]
    assert got[1][3:14] == [*(f"- k{9 - i}: " + ('["v1","ü"]' if i == 1 else f"v{i}") for i in range(10)), head]
    assert len(got[1]) == 14 + 30 and all(x.startswith("ID: ") and " | Path: Chemistry > Glue " in x for x in got[1][14:])
    assert got[2][:5] == ["Name: Glue", "Description: ", "Technical Specifications:", "not json", head] and len(got[2]) == 35
    assert got[3] == ["Name: ", "Description: ", "Technical Specifications:", "", head, ""] and got[4][3:] == ["", head, ""]


def test_whole_prompt_always_has_thirty_options(spark, tmp_path):
    import duckdb

    from fieldtrace.queries import taxonomy

    rows = [(1, "Tile glue", "for leaf 40", '{"a":"b"}'), (2, "nothing", None, "{}"), (3, None, None, None), (4, "glue " + " ".join(f"leaf{k}" for k in range(40)), None, None)]
    spark.createDataFrame(rows, "listing_id long, product_name string, short_description string, technical_specs string").write.parquet(f"{tmp_path}/products.parquet")
    leaves = [(100 + k, "Glue" if k in (3, 39) else f"leaf{k}", "subcategory", "1", []) for k in range(40)]
    spark.createDataFrame([(1, "Chemistry", "category", None, []), *leaves], "canon_id int, name string, level string, parent_canon_id string, aliases array<string>").write.parquet(f"{tmp_path}/canonical_categories.parquet")
    got = {r["listing_id"]: r["context"] for r in taxonomy.prompt_whole(spark, str(tmp_path)).collect()}
    sql = duckdb.connect()
    for name in ("products", "canonical_categories"):
        sql.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert got == dict(sql.execute(taxonomy.SQL["prompt_whole"]).fetchall())
    ids = {k: [int(x.split()[1]) for x in c.split("\n") if x.startswith("ID: ")] for k, c in got.items()}
    assert ids[1] == [103, 139, *(100 + k for k in range(29) if k != 3)] and ids[2] == ids[3] == list(range(100, 130)) and len(ids[4]) == 30
    assert "ID: 100 | Similarity: 0.000000 | Path: Chemistry > leaf0" in got[2]
