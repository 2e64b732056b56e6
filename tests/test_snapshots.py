import random
from datetime import datetime as T

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from fieldtrace.operators import snapshots as S

ROWS = "snapshot_no int, workspace string, kind string, id string, data string, version int, loaded_at timestamp, status string"
LOG = "workspace string, snapshot_no int, status string"
NOW = T(2024, 1, 1)


def changes(spark, rows, log, **kw):
    df = spark.createDataFrame([(*r, NOW, "clash") for r in rows], ROWS)
    return {tuple(r) for r in S.snapshot_changes(df, spark.createDataFrame(log, LOG), **kw).collect()}


def test_changes_versions_and_json(spark):
    rows = [
        (1, "w", "run", "a", '{"x": 1, "y": [1, 2]}', 1), (1, "w", "run", "b", "{}", 1), (1, "w", "run", "c", None, 1), (1, "w", "run", "d", "not json", 1),
        (2, "w", "run", "x", "{}", 1),  # failed snapshot
        (3, "w", " RUN ", "a", '{ "y" : [1.0,2], "x":1e0 }', 1), (3, "w", "run", "b", '{"z": null}', 3), (3, "w", "run", "b", "{}", 2), (3, "w", "run", "c", "null", 1), (3, "w", "run", "d", "not json", 1),
        (3, "w", "run", "e", "{}", 1), (3, "w", "run", "e", "{}", 1), (3, "w", None, "f", "{}", 1),
        (1, "v", "run", "a", "{}", 1),
    ]
    log = [("w", 1, "complete"), ("w", 2, "failed"), ("w", 3, " Complete "), ("v", 1, "complete"), ("v", 2, "complete"), (None, 1, "complete")]
    assert changes(spark, rows, log) == {
        ("w", "run", "b", 3, "changed"), ("w", "run", "c", 3, "changed"), ("w", "run", "e", 3, "added"), ("v", "run", "a", 2, "removed")}


@pytest.mark.parametrize("cells,rounds", [(6, 1), (6, 4), (384, 3)])
def test_small_tables_grow_or_fall_back(spark, cells, rounds):
    rnd = random.Random(3)
    old = {str(k): str(rnd.random()) for k in range(300)}
    new = {k: (v if rnd.random() < 0.6 else "1") for k, v in old.items() if rnd.random() < 0.8} | {f"n{k}": "0" for k in range(60)}
    rows = [(n, "w", "k", i, d, 1) for n, s in ((1, old), (2, new)) for i, d in s.items()]
    want = {("w", "k", i, 2, "added" if i not in old else "removed" if i not in new else "changed") for i in old.keys() | new.keys() if old.get(i) != new.get(i)}
    assert changes(spark, rows, [("w", 1, "complete"), ("w", 2, "complete")], keys_per_bucket=64, first_cells=cells, rounds=rounds) == want


def test_empty(spark):
    assert changes(spark, [], [("w", 1, "complete")]) == set()
    assert changes(spark, [(1, "w", "k", "i", "{}", 1)], []) == set()


def test_hash_equals_built_in(spark):
    vals = [0, 1, -1, 2**62, -(2**63), 12345678901]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in vals], "v long").select(F.xxhash64("v")).collect()]
    assert S.xx_long(np.array(vals, np.int64), 42).tolist() == got


json_values = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=4), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.text(max_size=3), c, max_size=3), max_leaves=6)


@settings(max_examples=60, deadline=None)
@given(json_values)
def test_canonical_json_ignores_layout(value):
    import json

    spaced = json.dumps(value, indent=2, ensure_ascii=False)
    assert S.canonical_json(json.dumps(value)) == S.canonical_json(spaced)


def test_canonical_json_tells_apart():
    texts = [None, "null", "0", '"0"', "[1,2]", "[2,1]", '{"a":null}', "{}", "true", "1", "{", "123456789012345678901.5", "123456789012345678901.25"]
    assert len({S.canonical_json(t) for t in texts}) == len(texts)
    assert S.canonical_json("100") == S.canonical_json("1e2") == S.canonical_json("100.0")
    assert S.canonical_json('"\\u00e9"') == S.canonical_json('"é"')
