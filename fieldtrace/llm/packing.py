"""Filling containers of fixed capacity with documents, balanced by cost.

The cost of a piece of n tokens is LINEAR * n + QUADRATIC * n * n, the work of
a transformer layer with attention inside the piece. Within one shard of
documents the number of sequences is the least that their tokens allow; pieces
are taken in descending length and each goes to the sequence of lowest cost
that still has room. A new sequence is opened only if none has room. A document
is cut only if it alone exceeds the capacity: into full containers and a rest.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from fieldtrace.runtime import cut

LINEAR = 1.0
QUADRATIC = 1.0 / 4096
#: Tokens that one shard holds on average; it bounds the memory of a task.
SHARD_TOKENS = 1 << 21

_PACKED = "budget_name string, container string, doc_id long, token_from int, token_to int"


class _LeastCost:
    """Sequences by remaining room; finds the cheapest with at least some room.

    A tree over the rooms 0..capacity holds at each node the least cost below.
    """

    def __init__(self, capacity: int):
        self.leaves = 1
        while self.leaves <= capacity:
            self.leaves *= 2
        self.none = (float("inf"), -1)
        self.best = [self.none] * (2 * self.leaves)
        self.heaps: dict[int, list] = {}

    def _up(self, room: int) -> None:
        best, k = self.best, self.leaves + room
        heap = self.heaps.get(room)
        best[k] = heap[0] if heap else self.none
        k //= 2
        while k:
            new = min(best[2 * k], best[2 * k + 1])
            if new == best[k]:
                break
            best[k] = new
            k //= 2

    def push(self, room: int, cost: float, which: int) -> None:
        heapq.heappush(self.heaps.setdefault(room, []), (cost, which))
        self._up(room)

    def pop(self, room: int) -> tuple[float, int, int] | None:
        """(cost, sequence, its room) of the cheapest with at least ``room``."""
        best, k, found, at = self.best, self.leaves + room, self.none, 0
        low = k
        if best[low] < found:
            found, at = best[low], low
        while low > 1:
            if low % 2 == 0 and best[low + 1] < found:
                found, at = best[low + 1], low + 1
            low //= 2
        if found[1] < 0:
            return None
        while at < self.leaves:
            at = 2 * at if best[2 * at] == found else 2 * at + 1
        have = at - self.leaves
        heapq.heappop(self.heaps[have])
        self._up(have)
        return found[0], found[1], have


def pack(sizes: np.ndarray, capacity: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> np.ndarray:
    """Sequence number of each piece; sizes are 1..capacity in descending order."""
    total = int(sizes.sum())
    count = -(-total // capacity)
    tree = _LeastCost(capacity)
    opened = 0
    out = np.empty(len(sizes), np.int64)
    for k, size in enumerate(sizes.tolist()):
        # an unopened sequence costs nothing, so it is the cheapest there is
        if opened < count:
            cost, which, room = 0.0, opened, capacity
            opened += 1
        else:
            found = tree.pop(size)
            if found is None:
                cost, which, room = 0.0, opened, capacity
                opened += 1
                count = opened
            else:
                cost, which, room = found
        out[k] = which
        if room > size:
            tree.push(room - size, cost + linear * size + quadratic * size * size, which)
    return out


def _pack_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    capacity, shard = int(pdf["capacity"].iat[0]), int(pdf["shard"].iat[0])
    pdf = pdf.sort_values(["size", "doc_id", "token_from"], ascending=[False, True, True], kind="stable")
    which = pack(pdf["size"].to_numpy(np.int64), capacity)
    start = pdf["token_from"].to_numpy(np.int32)
    return pd.DataFrame({
        "budget_name": pdf["budget_name"], "container": [f"{shard}-{k}" for k in which.tolist()], "doc_id": pdf["doc_id"],
        "token_from": start, "token_to": start + pdf["size"].to_numpy(np.int32),
    })


def pack_documents(sizes: DataFrame, budgets: DataFrame, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(budget_name, container, doc_id, token_from, token_to) for each capacity.

    ``sizes``: (doc_id, n_tokens); ``budgets``: (budget_name, capacity_tokens).
    token_to is exclusive. Containers are numbered within a budget. Full parts
    of documents longer than the capacity have containers of their own, which
    take no packing. Documents without tokens (null or 0) need no room: they
    have one row with a null container and the range 0..0. A capacity that is
    null or below 1 is an error. A document given more than once is packed once,
    with its greatest size; empty tables give no rows. Shards are hashes of the document, so a hot
    source has no influence; the last container of each shard may stay part
    empty, at most one in SHARD_TOKENS / capacity.
    """
    given = sizes.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("n_tokens"), F.lit(0)).cast("int").alias("n_tokens"))
    written = cut(given.groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens")))
    total = written.agg(F.sum("n_tokens")).first()[0] or 0
    shards = max(1, round(total / shard_tokens))
    # a list of capacities is configuration: its size is checked before use
    chosen = [(r["budget_name"], r["capacity_tokens"]) for r in budgets.select("budget_name", "capacity_tokens").distinct().limit(1_001).collect()]
    if len(chosen) > 1_000 or any(c is None or c < 1 for _, c in chosen):
        raise ValueError("budgets need at most 1000 capacities of at least 1 token")
    spark = sizes.sparkSession
    if not chosen:
        return spark.createDataFrame([], _PACKED)
    options = F.array(*[F.struct(F.lit(n).alias("budget_name"), F.lit(int(c)).alias("capacity")) for n, c in chosen])
    each = written.filter("n_tokens > 0").withColumn("b", F.explode(options)).select("doc_id", "n_tokens", "b.budget_name", "b.capacity")
    full = each.filter("n_tokens >= capacity").withColumn("k", F.explode(F.sequence(F.lit(0), F.floor(F.col("n_tokens") / F.col("capacity")).cast("int") - 1)))
    full = full.select(
        "budget_name", F.concat(F.lit("d"), F.col("doc_id"), F.lit("-"), F.col("k")).alias("container"), "doc_id",
        (F.col("k") * F.col("capacity")).cast("int").alias("token_from"), ((F.col("k") + 1) * F.col("capacity")).cast("int").alias("token_to"))
    rest = each.withColumn("size", F.col("n_tokens") % F.col("capacity")).filter("size > 0")
    rest = rest.select("budget_name", "capacity", "doc_id", (F.col("n_tokens") - F.col("size")).alias("token_from"), "size", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).alias("shard"))
    packed = rest.groupBy("budget_name", "shard").applyInPandas(_pack_shard, _PACKED)
    none = written.filter("n_tokens = 0").withColumn("b", F.explode(options)).select(
        "b.budget_name", F.lit(None).cast("string").alias("container"), "doc_id", F.lit(0).alias("token_from"), F.lit(0).alias("token_to"))
    return packed.unionByName(full).unionByName(none)


def fill_report(packed: DataFrame, budgets: DataFrame) -> DataFrame:
    """Containers, tokens and unused share per budget."""
    used = packed.filter("container is not null").groupBy("budget_name").agg(F.countDistinct("container").alias("containers"), F.sum(F.col("token_to") - F.col("token_from")).alias("tokens"))
    room = F.col("containers") * F.col("capacity_tokens")
    return used.join(budgets.select("budget_name", "capacity_tokens").distinct(), "budget_name").select(
        "budget_name", "capacity_tokens", "containers", "tokens", F.round(1 - F.col("tokens") / room, 6).alias("unused_share"))
