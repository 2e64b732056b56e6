import itertools
import json
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

pytest.importorskip("fieldtrace.llm")
from fieldtrace.llm import copies, encode, items, mapping, packing  # noqa: E402

PATH = encode.vocabulary_path()


def reference(texts):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


# problem 7
@settings(max_examples=80, deadline=None)
@given(st.text(st.characters(blacklist_categories=["Cs"]), max_size=60))
def test_ids_equal_the_reference(text):
    assert encode.encode(text, PATH) == reference([text])[0]


def test_long_parts_and_both_merges():
    ranks = encode.read_ranks(PATH)
    for text in ("a" * 3000, "ab" * 500, "的" * 400, " " * 900, "<|endoftext|>", "supercalifragilistic" * 20):
        assert encode.encode(text, PATH) == reference([text])[0]
    for part in (b"hello", b"x" * 50, "größer".encode(), bytes(range(33, 90))):
        assert encode.merge_scan(part, ranks) == encode.merge_heap(part, ranks)


def test_null_empty_and_blank_texts(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, " \n", 5), (4, "Hi", 5), (4, "Hi", 5)], "doc_id long, text string, ids int")
    got = sorted((r["doc_id"], list(r["ids"])) for r in encode.encode_documents(df).collect())
    assert got == [(1, []), (2, []), (3, reference([" \n"])[0]), (4, reference(["Hi"])[0]), (4, reference(["Hi"])[0])]
    assert encode.encode_documents(df.limit(0)).count() == 0
    assert sorted(r["n_tokens"] for r in encode.token_counts(df).collect()) == [0, 0, 1, 1, len(reference([" \n"])[0])]


# problem 8
def check_packed(rows, sizes, capacities):
    for name, capacity in capacities.items():
        mine = [r for r in rows if r["budget_name"] == name]
        room, parts = {}, {}
        for r in mine:
            n = r["token_to"] - r["token_from"]
            parts.setdefault(r["doc_id"], []).append((r["token_from"], r["token_to"]))
            if r["container"] is None:
                assert n == 0
                continue
            room[r["container"]] = room.get(r["container"], 0) + n
        assert max(room.values(), default=0) <= capacity
        assert parts.keys() == sizes.keys()
        for doc, n in sizes.items():
            spans = sorted(parts[doc])
            assert [a for a, _ in spans[1:]] == [b for _, b in spans[:-1]] and spans[0][0] == 0 and spans[-1][1] == (n or 0)
            assert len(spans) == max(1, -(-(n or 0) // capacity))


def test_packing(spark):
    rnd = random.Random(1)
    sizes = {k: rnd.choice([0, None, rnd.randint(1, 900), rnd.randint(1, 60)]) for k in range(400)}
    df = spark.createDataFrame(list(sizes.items()), "doc_id long, n_tokens int")
    budgets = spark.createDataFrame([("a", 128), ("b", 512), ("b", 512)], "budget_name string, capacity_tokens int")
    rows = packing.pack_documents(df.unionAll(df.limit(5)), budgets, shard_tokens=20_000).collect()
    check_packed(rows, sizes, {"a": 128, "b": 512})
    total = sum(n or 0 for n in sizes.values())
    assert len({r["container"] for r in rows if r["budget_name"] == "b" and r["container"]}) <= 1.1 * total / 512
    assert packing.pack_documents(df.limit(0), budgets).count() == 0
    with pytest.raises(ValueError):
        packing.pack_documents(df, spark.createDataFrame([("z", 0)], "budget_name string, capacity_tokens int"))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=60))
def test_lowest_cost_with_room(sizes):
    sizes = sorted(sizes, reverse=True)
    got = packing.pack(np.array(sizes), 50)
    count = -(-sum(sizes) // 50)
    cost, room = {}, {}
    for k, (size, seq) in enumerate(zip(sizes, got.tolist())):
        if seq in room:  # the cheapest of those with room, and none was left unopened
            fit = [s for s in room if room[s] >= size]
            assert seq == min(fit, key=lambda s: (cost[s], s)) and len(room) >= count
        else:
            assert len(room) < count or not [s for s in room if room[s] >= size]
        room[seq] = room.get(seq, 50) - size
        cost[seq] = cost.get(seq, 0.0) + packing.LINEAR * size + packing.QUADRATIC * size * size
        assert room[seq] >= 0


# problem 2
PRODUCTS = "listing_id long, brand string, product_name string, source_url string, technical_specs string, key string, id long"


def test_copies(spark):
    rows = [
        (5, "ACME®", "Drill  X-1", "https://a.example/p?b=2&a=1", '{"Colour": "Red", "Use with": ["A b", "c"]}'),
        (3, " acme ", "drill (x 1)", "HTTPS://a.example/p?a=1&b=2", '{"use with:" : ["a  B","C"], "colour":"red "}'),
        (4, "acme", "drill 1 x", "https://a.example/p?a=1&b=2", '{"use with": ["a b", "c"], "colour":"red"}'),
        (6, "acme", "drill x 1", "https://a.example/p?a=1&b=2", '{"use with": ["a", "b c"], "colour":"red"}'),
        (7, None, "drill x 1", None, None), (8, "", "drill x 1", None, None), (9, None, "Drill: X 1", None, None), (10, None, "drill x 1", None, "{}"),
        (11, "q", None, None, "[1]"), (12, "Q", None, None, " [1] "), (None, "q", None, None, "[1]"),
    ]
    df = spark.createDataFrame([(*r, "clash", 0) for r in rows], PRODUCTS)
    got = {(r["kept_id"], r["id"]) for r in copies.collapse(copies.product_keys(df)).filter("id <> kept_id").collect()}
    assert got == {(3, 5), (7, 9), (11, 12)}
    assert copies.collapse(copies.product_keys(df.limit(0))).count() == 0


def test_hot_copies_take_two_levels(spark):
    df = spark.range(60_000).selectExpr("id", "case when id % 3 = 0 then unhex('AAAA') when id % 3 = 1 then null else unhex(concat('FF', lpad(hex(id), 8, '0'))) end as key")
    got = {r["n"]: (r["kept"], r["rows"]) for r in copies.collapse(df, hot_rows=1_000).groupBy("copies").agg({"kept_id": "min", "id": "count"}).toDF("n", "kept", "rows").collect()}
    assert got == {20_000: (0, 40_000)}
    assert {(r["copies"], r["n"]) for r in copies.records(df, hot_rows=1_000).groupBy("copies").count().toDF("copies", "n").collect()} == {(20_000, 2), (1, 20_000)}


# problem 3
CANON = "canon_id int, name string, level string, parent_canon_id int, aliases array<string>, key string"


def test_mapping(spark):
    canon = spark.createDataFrame([
        (1, "Wall painting", "category", None, ["Decorating"], "x"), (2, "Grinding and sanding", "category", None, None, "x"), (3, "Work safety", "category", None, ["PPE"], "x"),
        (4, "Joint sealing tape", "subcategory", 1, [], "x"), (5, "Self-smoothing compound", "subcategory", 1, [], "x"), (6, "Hand tools", "category", None, [], "x")], CANON)
    typed = {
        "Wall painting": None, "  ": None, None: None, "wall PAINTING": 1, "Wallpaintng": 1, "painting - Wall": 1, "[A12] Wall paint.": 1, "Home > Wall&nbsp;painting (new)": 1, "decorating": 1,
        "Grinding+&amp;+s&amp;ing": 2, "sanding, Grinding u.": 2, "Work saftey": 3, "ppe, various": 3, "Hu._tools": 6, "Wedding gifts": 0, "12345": 0, "Joint sealing tape": 0, "???": 0}
    df = spark.createDataFrame([(k, v, "Joint. tape" if v == "decorating" else None, "c") for k, v in enumerate(typed)], "listing_id long, category string, subcategory string, canon_id string")
    got = {(r["listing_id"], r["field_name"]): r["canon_id"] for r in mapping.map_records(df, "listing_id", ["category", "subcategory"], canon).collect()}
    want = {(k, "category"): v for k, (t, v) in enumerate(typed.items()) if v is not None} | {(list(typed).index("decorating"), "subcategory"): 4}
    assert got == want
    assert mapping.map_records(df.limit(0), "listing_id", ["category"], canon).count() == 0
    none = mapping.map_records(df, "listing_id", ["category"], canon.limit(0)).collect()
    assert len(none) == len(typed) - 2 and {r["canon_id"] for r in none} == {0}
    missed = {(r["value"], r["records"]) for r in mapping.unmatched(df, ["category"], canon).collect()}
    assert ("Wedding gifts", 1) in missed and ("PPE", 1) not in missed


def test_values_mean_what_they_say(spark):
    names = ["Home", "Class 1 anchors", "Class 2 anchors", "Roofing", "Plumbing", "Trestle"]
    canon = spark.createDataFrame([(k + 1, n, "category", None, None, "x") for k, n in enumerate(names)], CANON)
    typed = {"HOME": 1, "home, new": 1, "CLASS 1 ANCHORS": 2, "class 2 anchors": 3, "clas 2 anchors": 3, "Roving": 0, "Rolling": 0, "Footing": 0, "Climbing": 0, "Roofnig": 4, "Roofin": 4, "Trestel": 6, "Tretsel": 0}
    df = spark.createDataFrame([("category", t) for t in typed], "level string, value string")
    got = {r["value"]: (r["canon_id"], r["distance"]) for r in mapping.map_values(df, canon).collect()}
    assert {t: c for t, (c, _) in got.items()} == typed
    assert got["HOME"][1] == 0 and got["Roofnig"][1] == 2 and got["Roving"][1] is None


def test_pigeonhole_finds_all_within_k(spark):
    rnd = random.Random(5)
    names = ["channelgrating", "rollingtower", "trestle", "decking", "vapourcontrolsheet"]
    typed = set()
    for name in names:
        for _ in range(40):
            t = list(name)
            for _ in range(rnd.randint(0, 4)):
                i = rnd.randrange(len(t))
                rnd.choice([lambda: t.pop(i), lambda: t.insert(i, rnd.choice("abxyz")), lambda: t.__setitem__(i, rnd.choice("abxyz"))])()
            typed.add("".join(t))

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return row[-1]

    def near_enough(t, n):  # one slip in a short name, two in a long one; a swap is two edits
        d = lev(t, n)
        return d <= 4 if len(n) > mapping.ONE_SLIP else d <= 1 or (d == 2 and sorted(t) == sorted(n))

    want = {}
    for t in typed:
        near = sorted((lev(t, n), i) for i, n in enumerate(names) if near_enough(t, n))
        if near and (len(near) == 1 or near[0][0] < near[1][0]):
            want[t] = near[0][1]
    keys = spark.createDataFrame([("c", n, i, True) for i, n in enumerate(names)], "level string, key string, canon_id int, whole boolean")
    df = spark.createDataFrame([("c", t) for t in typed], "level string, key string")
    assert {r["key"]: r["canon_id"] for r in mapping.closest(df, keys).collect()} == want


# problem 4; more in test_items.py
def test_stars(spark):
    sets = spark.createDataFrame([(1, 9), (2, 1), (3, 1), (4, 5), (5, 1), (6, 1)], "set long, support long")
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5)], "a long, b long")
    assert {r["set"]: r["centre"] for r in items.star_clusters(sets, pairs).collect()} == {1: 1, 2: 1, 3: 4, 4: 4, 5: 4, 6: 6}
    assert {r["centre"] for r in items.star_clusters(sets, pairs.limit(0)).collect()} == {1, 2, 3, 4, 5, 6}


def test_stars_of_a_long_chain(spark):
    n = 64  # a round takes two of them
    sets = spark.createDataFrame([(k, n - k) for k in range(n)], "set long, support long").coalesce(1)
    pairs = spark.createDataFrame([(k, k + 1) for k in range(n - 1)], "a long, b long").coalesce(1)
    assert {r["set"]: r["centre"] for r in items.star_clusters(sets, pairs).collect()} == {k: k - k % 2 for k in range(n)}

# problem 9: test_spam.py
