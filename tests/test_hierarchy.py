import random

import pytest

from fieldtrace.operators import hierarchy as H

SCHEMA = "id long, parent_id long, name string, id_path string"


def brute(links):
    parent = dict(links)
    out = {}
    for node in parent:
        chain, x = [node], node
        while parent.get(x) in parent and parent[x] not in chain:
            x = parent[x]
            chain.append(x)
        up = parent.get(x)
        if up in parent:  # ran into itself
            ring = chain[chain.index(up):]
            out[node] = (min(ring), 0, "cycle")
        else:
            out[node] = (x, len(chain), ".".join(map(str, reversed(chain))))
    return out


def run(spark, links, **kw):
    df = spark.createDataFrame([(i, p, "n", None) for i, p in links], SCHEMA)
    return {r["id"]: (r["root_id"], r["depth"], r["full_path"]) for r in H.hierarchy(df, **kw).collect()}


@pytest.mark.parametrize("fragment", [3, 8, 1000])
def test_small_forest_with_loops(spark, fragment):
    links = [(1, None), (2, 1), (3, 2), (4, 99), (5, 4), (10, 11), (11, 12), (12, 10), (13, 12), (14, 13), (20, 20), (21, 20)]
    assert run(spark, links, fragment_rows=fragment) == brute(links)


@pytest.mark.parametrize("seed", range(2))
def test_random_deep_forest(spark, seed):
    rnd = random.Random(seed)
    ids = list(range(1000, 1220))
    rnd.shuffle(ids)
    links = [(x, rnd.choice([None, ids[k - 1], ids[rnd.randrange(len(ids))], ids[max(0, k - 1)]]) if k else None) for k, x in enumerate(ids)]
    assert run(spark, links, fragment_rows=40) == brute(links)


def test_long_chain_and_hot_parent(spark):
    links = [(1, None)] + [(k, k - 1) for k in range(2, 120)] + [(k, 5) for k in range(1000, 1300)]
    assert run(spark, links, fragment_rows=30) == brute(links)


def test_no_bucket_takes_all_children_of_one_parent(spark):
    links = [(k, 1 if k > 1 else None) for k in range(1, 3001)]
    df = spark.createDataFrame([(i, p, str(i), 1, i) for i, p in links], "id long, parent long, seg string, seg_n int, lo long")
    for level in range(4):
        sizes = [r["count"] for r in H._bucketed(df, level, 3000, 100, None).groupBy("bucket").count().collect()]
        assert max(sizes) < 250 and sum(sizes) == 3000


def test_nulls_repeats_and_empty(spark):
    assert run(spark, []) == {}
    assert run(spark, [(None, 1), (1, None), (1, None), (2, 1)]) == {1: (1, 1, "1"), 2: (1, 2, "1.2")}


def test_latest_row_wins_and_ties_are_settled(spark):
    df = spark.createDataFrame([(1, 5, "2024-01-01"), (1, 7, "2024-02-01"), (2, 3, None), (2, 4, "2023-01-01"), (3, 1, "x"), (3, 2, "x"), (None, 1, "x")], "id long, parent_id long, loaded_at string")
    assert {(r["id"], r["parent_id"]) for r in H.latest_rows(df).collect()} == {(1, 7), (2, 4), (3, 2)}


def test_descendants(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (3, 2), (9, 9)], "id long, parent_id long")
    got = {tuple(r) for r in H.descendants(H.hierarchy(df)).collect()}
    assert got == {(1, 2, 1), (1, 3, 2), (2, 3, 1)}


def test_a_long_chain_is_split_by_bytes(spark):
    from fieldtrace.operators import hierarchy as H

    n = 6_000
    rows = spark.range(n).selectExpr("id + 100000 as id", "case when id > 0 then id + 99999 end as parent_id")
    got = H.hierarchy(rows).agg({"depth": "max", "full_path": "max"}).first()
    assert got["max(depth)"] == n
    deep = H.hierarchy(rows).filter(f"depth = {n}").first()
    assert deep["root_id"] == 100000 and deep["full_path"] == ".".join(str(100000 + k) for k in range(n))
    # no path inside a fragment is longer than the bound
    import pandas as pd

    part = pd.DataFrame({"bucket": 0, "id": range(n), "parent": pd.array([None, *range(n - 1)], "Int64"), "seg": [str(k) for k in range(n)], "seg_n": 1, "lo": range(n)})
    local = H._contract(part)
    assert local["below"].map(len).max() <= H.FRAGMENT_BYTES and local["split"].sum() > 5


def test_long_chain_with_loops_and_wide_nodes(spark):
    from fieldtrace.operators import hierarchy as H

    links = [(k, k - 1 if k else None) for k in range(700)] + [(1000 + k, 699) for k in range(300)] + [(2000 + k, 2000 + (k + 1) % 600) for k in range(600)] + [(3000 + k, 2999 + k if k else 2500) for k in range(500)]
    df = spark.createDataFrame(links, "id long, parent_id long")
    old = H.FRAGMENT_BYTES
    H.FRAGMENT_BYTES = 60
    try:
        got = {r["id"]: (r["root_id"], r["depth"], r["full_path"]) for r in H.hierarchy(df, fragment_rows=200).collect()}
    finally:
        H.FRAGMENT_BYTES = old
    path = ".".join(map(str, range(700)))
    assert got[699] == (0, 700, path) and got[1299] == (0, 701, path + ".1299") and got[2001] == got[3499] == (2000, 0, "cycle") and len(got) == len(links)
