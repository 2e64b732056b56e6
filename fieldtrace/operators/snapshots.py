"""What changed between consecutive full snapshots, by invertible Bloom tables.

Each snapshot's (key hash, content hash) pairs are added to small tables, one
per hash bucket of keys; subtracting two snapshots' tables leaves only the
pairs that differ. Those are peeled off; buckets with too many differences for
their table are done again with larger tables, and compared exactly if even
those fail.
"""

from __future__ import annotations

import hashlib
import json
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from fieldtrace.runtime import cut

KEYS_PER_BUCKET = 1_024
FIRST_CELLS = 384
GROWTH = 4
ROUNDS = 3
CELLS_PER_TASK = 150_000


class _Long(Exception):
    pass


def _number(text: str) -> int | float:
    d = Decimal(text)
    if d == 0:
        return 0
    _, digits, exp = d.as_tuple()
    while digits[-1] == 0:
        digits, exp = digits[:-1], exp + 1
    if 0 <= exp < 400:
        return int("".join(map(str, digits))) * 10**exp * (-1 if d < 0 else 1)
    if len(digits) <= 15 and -290 < d.adjusted() < 290:
        return float(d)  # up to 15 digits a double tells values apart
    raise _Long


def _exact(value) -> str:
    """Canonical text of any parsed JSON value, numbers of any length."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k)}:{_exact(v)}" for k, v in sorted(value.items())) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_exact, value)) + "]"
    if isinstance(value, Decimal):
        if value == 0:
            return "0"
        sign, digits, exp = value.as_tuple()
        while digits[-1] == 0:
            digits, exp = digits[:-1], exp + 1
        return f"{'-' * sign}{''.join(map(str, digits))}e{exp}"
    return json.dumps(value)


def _refuse(text: str):
    raise ValueError(text)


def canonical_json(text: str | None) -> str:
    """One text for all spellings of a JSON value; null and invalid texts have their own."""
    if text is None:
        return "absent"
    body = text.removeprefix("﻿")
    try:
        try:
            return "j" + json.dumps(json.loads(body, parse_float=_number, parse_constant=_refuse), sort_keys=True, separators=(",", ":"))
        except _Long:
            return "x" + _exact(json.loads(body, parse_float=Decimal, parse_int=Decimal, parse_constant=_refuse))
    except (ValueError, RecursionError):
        return "t" + text


def _digests(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: hashlib.md5(canonical_json(t).encode("utf-8", "surrogatepass")).hexdigest(), na_action=None)


def json_digest(column):
    """128-bit digest of the JSON value that a text column holds."""
    from pyspark.sql.functions import pandas_udf

    return pandas_udf(_digests, "string")(column)


# XXH64 of one 8-byte word, as the built-in xxhash64 computes it for a long.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def xx_long(values: np.ndarray, seed: np.ndarray | int) -> np.ndarray:
    with np.errstate(over="ignore"):
        v = values.astype(np.int64).view(np.uint64)
        s = np.full(v.shape, seed, np.int64).view(np.uint64) if np.isscalar(seed) else seed.astype(np.int64).view(np.uint64)
        h = s + _P5 + np.uint64(8)
        h ^= _rotl(v * _P2, 31) * _P1
        h = _rotl(h, 27) * _P1 + _P4
        h ^= h >> np.uint64(33)
        h *= _P2
        h ^= h >> np.uint64(29)
        h *= _P3
        h ^= h >> np.uint64(32)
    return h.view(np.int64)


def _peeler(cells: int):
    third = cells // 3

    def peel(pdf: pd.DataFrame) -> pd.DataFrame:
        """All tables of one task at once: peel pure cells until none is left."""
        code, tables = pd.factorize(pd.MultiIndex.from_frame(pdf[["workspace", "pair", "bucket"]]))
        place = code.astype(np.int64) * cells + pdf["cell"].to_numpy(np.int64)
        order = np.argsort(place)
        place, code = place[order], code[order]
        n, kx, vx, cx = (pdf[c].to_numpy(np.int64)[order].copy() for c in ("n", "kx", "vx", "cx"))
        out_code, out_k, out_v, out_s = [], [], [], []
        for _ in range(64 + len(place)):
            at = np.flatnonzero((np.abs(n) == 1))
            at = at[xx_long(vx[at], xx_long(kx[at], 42)) == cx[at]]
            if not len(at):
                break
            seen = pd.DataFrame({"t": code[at], "k": kx[at], "v": vx[at], "c": cx[at], "s": n[at]}).drop_duplicates(["t", "k", "v"])
            t, k, v, c, s = (seen[x].to_numpy(np.int64) for x in "tkvcs")
            for j in range(3):
                cell = np.mod(xx_long(np.full(len(c), j, np.int64), xx_long(c, 42)), third) + j * third
                want = t * cells + cell
                i = np.searchsorted(place, want)
                i[i == len(place)] = 0
                hit = place[i] == want
                i = i[hit]
                np.subtract.at(n, i, s[hit])
                np.bitwise_xor.at(kx, i, k[hit])
                np.bitwise_xor.at(vx, i, v[hit])
                np.bitwise_xor.at(cx, i, c[hit])
            out_code.append(t), out_k.append(k), out_v.append(v), out_s.append(s)
        left = np.zeros(len(tables), bool)
        left[code[(n != 0) | (kx != 0) | (vx != 0) | (cx != 0)]] = True
        t, k, v, s = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (out_code, out_k, out_v, out_s))
        keep = ~left[t] if len(t) else np.empty(0, bool)
        t, k, v, s = t[keep], k[keep], v[keep], s[keep]
        failed = np.flatnonzero(left)
        names = tables.to_frame(index=False, name=["workspace", "pair", "bucket"])
        rows = names.iloc[np.concatenate([t, failed])].reset_index(drop=True)
        rows["kh"], rows["dh"] = np.concatenate([k, 0 * failed]), np.concatenate([v, 0 * failed])
        rows["sign"] = np.concatenate([s, 0 * failed]).astype(np.int32)  # 0: this bucket failed
        return rows.astype({"pair": np.int32, "bucket": np.int64})

    return peel


_PEELED = "workspace string, pair int, bucket long, kh long, dh long, sign int"


def _tables(items: DataFrame, cells: int, tasks: int) -> DataFrame:
    """Subtracted tables: one row per cell that isn't empty."""
    third = cells // 3
    check = F.xxhash64("kh", "dh")
    spots = F.array(*[F.pmod(F.xxhash64(F.col("check"), F.lit(j).cast("long")), F.lit(third)) + j * third for j in range(3)])
    placed = items.withColumn("check", check).withColumn("cell", F.explode(spots))
    summed = placed.groupBy("workspace", "pair", "bucket", "cell").agg(
        F.sum("sign").alias("n"), F.bit_xor("kh").alias("kx"), F.bit_xor("dh").alias("vx"), F.bit_xor("check").alias("cx"))
    summed = summed.filter("n != 0 or kx != 0 or vx != 0 or cx != 0")
    return summed.withColumn("task", F.pmod(F.xxhash64("workspace", "pair", "bucket"), F.lit(tasks)))


def snapshot_changes(rows: DataFrame, log: DataFrame, keys_per_bucket: int = KEYS_PER_BUCKET, first_cells: int = FIRST_CELLS, rounds: int = ROUNDS) -> DataFrame:
    """(workspace, kind, id, snapshot_no, change_type) between complete snapshots.

    ``rows``: (snapshot_no, workspace, kind, id, data, version, loaded_at);
    ``log``: (workspace, snapshot_no, status). Only snapshots logged as
    'complete' count, each against the workspace's previous complete one; the
    first has no changes. kind is compared in lower case without surrounding
    blanks. Of rows with one key the highest version counts (then the latest
    loaded_at, then the greatest digest). data is compared as a JSON value;
    text that isn't JSON is compared as it is; null data equals only null data.
    Rows with a null kind or id have no key and are left out. A complete
    snapshot without rows removes everything. Empty tables give no rows.
    """
    ends = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
    clean = lambda c: F.lower(F.regexp_replace(c, ends, ""))
    w = Window.partitionBy("workspace").orderBy("snapshot_no")
    done = log.filter(clean("status") == "complete").select("workspace", "snapshot_no").filter("workspace is not null and snapshot_no is not null").distinct()
    done = done.withColumn("earlier", F.lag("snapshot_no").over(w)).withColumn("later", F.lead("snapshot_no").over(w))
    valid = rows.filter("kind is not null and id is not null").join(done, ["workspace", "snapshot_no"])
    # bounded by the number of snapshots: sizes decide how many buckets a pair has
    sizes = valid.groupBy("workspace", "snapshot_no").agg(F.count("*").alias("rows"))
    most = cut(sizes.groupBy("workspace").agg(F.greatest(F.lit(1), F.ceil(F.max("rows") / keys_per_bucket)).cast("long").alias("buckets")))
    keyed = valid.join(most, "workspace").withColumn("kind", clean("kind")).withColumn("kh", F.xxhash64("workspace", "kind", "id")).select(
        "workspace", F.pmod("kh", "buckets").alias("bucket"), "snapshot_no", "earlier", "later", "kind", "id", "kh",
        F.struct("version", "loaded_at", json_digest(F.col("data")).alias("digest")).alias("row"))
    # one shuffle: a bucket's rows lie together from here on, so a bucket's
    # cells are summed where they are read and only sums travel
    one = keyed.repartition("workspace", "bucket").groupBy("workspace", "bucket", "snapshot_no", "earlier", "later", "kind", "id", "kh").agg(F.max("row")["digest"].alias("digest"))
    one = cut(one.withColumn("dh", F.xxhash64("digest")).sortWithinPartitions("workspace", "bucket"))
    signs = F.array(
        F.struct(F.col("snapshot_no").alias("pair"), F.lit(1).alias("sign"), F.col("earlier").isNotNull().alias("use")),
        F.struct(F.col("later").alias("pair"), F.lit(-1).alias("sign"), F.col("later").isNotNull().alias("use")))
    items = one.withColumn("s", F.explode(signs)).filter("s.use").select("workspace", F.col("s.pair").alias("pair"), "bucket", "kh", "dh", F.col("s.sign").alias("sign"))

    total = one.count()
    found, cells, again = [], first_cells, items
    failed = None
    for _ in range(rounds):
        tasks = max(1, total * 2 * cells // keys_per_bucket // CELLS_PER_TASK + 1)
        tables = _tables(again, cells, tasks).select("task", "workspace", "pair", "bucket", "cell", "n", "kx", "vx", "cx")
        peeled = cut(tables.groupBy("task").applyInPandas(_peeler(cells), _PEELED))
        found.append(peeled.filter("sign != 0").drop("bucket"))
        failed = peeled.filter("sign = 0").select("workspace", "pair", "bucket")
        if not failed.take(1):
            failed = None
            break
        again = items.join(failed, ["workspace", "pair", "bucket"], "left_semi")
        cells *= GROWTH
    recovered = found[0]
    for more in found[1:]:
        recovered = recovered.unionByName(more)
    # back from hashes to keys; the digest is the verified 128-bit one
    side = F.when(F.col("sign") == 1, F.col("snapshot_no")).otherwise(F.col("later")) == F.col("pair")
    named = one.join(recovered, ["workspace", "kh", "dh"]).filter(side).select("workspace", "pair", "kind", "id", "sign", "digest")
    if failed is not None:  # the exact way for what no table could hold
        both = one.withColumn("s", F.explode(signs)).filter("s.use").select("workspace", F.col("s.pair").alias("pair"), "bucket", F.col("s.sign").alias("sign"), "kind", "id", "digest")
        named = named.unionByName(both.join(failed, ["workspace", "pair", "bucket"], "left_semi").select("workspace", "pair", "kind", "id", "sign", "digest"))
    told = named.groupBy("workspace", "pair", "kind", "id").agg(F.max(F.when(F.col("sign") == 1, F.col("digest"))).alias("new"), F.max(F.when(F.col("sign") == -1, F.col("digest"))).alias("old"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("new") != F.col("old"), "changed")
    return told.withColumn("change_type", change).filter("change_type is not null").select("workspace", "kind", "id", F.col("pair").cast("int").alias("snapshot_no"), "change_type")
