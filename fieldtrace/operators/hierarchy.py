"""Parent-child links to full hierarchies.

Every partition contracts its own parent chains: a node points at the top of
its fragment (the *exit*) and knows the path below it. Exits whose parent lies
in another partition form a smaller quotient forest, which is solved the same
way; then the fragments are expanded. A chain that returns to itself inside a
partition is a local cycle; one through several fragments shows up as a local
cycle of some quotient.
"""

from __future__ import annotations


import pandas as pd
from pyspark.sql import DataFrame, functions as F

from fieldtrace.operators.skew import salted_join
from fieldtrace.runtime import cut

FRAGMENT_ROWS = 30_000
#: Longest path inside a fragment and bytes of all paths of a bucket; where a
#: single label is longer, a fragment still takes ``LEAST_LABELS`` of them.
FRAGMENT_BYTES, BUCKET_BYTES, LEAST_LABELS = 2_000, 60_000_000, 4
_LOCAL = "bucket long, id long, exit long, exit_parent long, below string, below_n int, below_lo long, loop long, split boolean"


def latest_rows(tree: DataFrame, id_col: str = "id", order_col: str = "loaded_at") -> DataFrame:
    """One row per id, the one with the greatest ``order_col``.

    Rows without an id are no nodes and are left out. Ties on ``order_col``
    (null counts as oldest) go to the greatest remaining row, so the result
    doesn't depend on the order of files.
    """
    rest = [c for c in tree.columns if c not in (id_col, order_col)]
    packed = F.max(F.struct(order_col, *rest)).alias("__row")
    one = tree.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(packed)
    return one.select(id_col, *[F.col(f"__row.`{c}`").alias(c) for c in (order_col, *rest)])


def _contract(pdf: pd.DataFrame) -> pd.DataFrame:
    """Local chains of one bucket: exit, path below it, or the loop's least id.

    A chain whose path would grow too long is split there: the node becomes an
    exit of its own, as if its parent lay elsewhere.
    """
    ids, seg, seg_n, lo = (pdf[c].tolist() for c in ("id", "seg", "seg_n", "lo"))
    at = {x: k for k, x in enumerate(ids)}
    parents = [None if p is pd.NA or p is None or p != p else int(p) for p in pdf["parent"].astype("Int64").tolist()]
    up = [at.get(p, -1) for p in parents]
    n = len(ids)
    top, loop = [-1] * n, [None] * n
    below, below_n, below_lo = [""] * n, [0] * n, [None] * n
    state = bytearray(n)  # 0 new, 1 on the present chain, 2 done
    split = [False] * n
    longest = max(FRAGMENT_BYTES, LEAST_LABELS * max(map(len, seg), default=0))
    for start in range(n):
        chain, k = [], start
        while k >= 0 and state[k] == 0:
            state[k] = 1
            chain.append(k)
            k = up[k]
        if k >= 0 and state[k] == 1:  # the chain ran into itself
            ring = chain[chain.index(k):]
            least = min(lo[r] for r in ring)
            for r in ring:
                loop[r], state[r] = least, 2
            chain = chain[: len(chain) - len(ring)]
        for k in reversed(chain):
            p = up[k]
            if p < 0:
                top[k] = k
            elif loop[p] is not None:
                loop[k] = loop[p]
            elif len(below[p]) + len(seg[k]) >= longest:
                top[k], split[k] = k, True
            else:
                top[k] = top[p]
                below[k] = f"{below[p]}.{seg[k]}" if below[p] else seg[k]
                below_n[k] = below_n[p] + seg_n[k]
                below_lo[k] = lo[k] if below_lo[p] is None else min(below_lo[p], lo[k])
            state[k] = 2
    return pd.DataFrame({
        "bucket": pdf["bucket"], "id": ids,
        "exit": pd.array([None if t < 0 else ids[t] for t in top], "Int64"),
        "exit_parent": pd.array([parents[t] if t >= 0 else None for t in top], "Int64"),
        "below": below, "below_n": pd.array(below_n, "int32"),
        "below_lo": pd.array(below_lo, "Int64"), "loop": pd.array(loop, "Int64"), "split": split,
    })


def _bucketed(nodes: DataFrame, level: int, count: int, fragment_rows: int, locality: str | None) -> DataFrame:
    """Adds the bucket of each node: about ``fragment_rows`` nodes each.

    With a locality column its values stay together, except those that alone
    exceed ``fragment_rows``. Otherwise a node joins its parent's bucket if a
    coin of the parent's id shows heads and its own shows tails: about a quarter
    of all links become local whatever the shape of the forest. Children of a
    parent with more than ``fragment_rows`` of them stay spread.
    """
    buckets = max(1, -(-count // fragment_rows))
    if buckets == 1:
        return nodes.withColumn("bucket", F.lit(0).cast("long"))
    coin = lambda c: F.pmod(F.xxhash64(F.lit(level * 7919), c), F.lit(2))
    wide = nodes.filter("parent is not null").groupBy("parent").agg(F.count("*").alias("__n")).filter(F.col("__n") > fragment_rows)
    nodes = salted_join(nodes, wide.select("parent", F.lit(True).alias("__wide")), "parent", "left")
    mate = F.when(F.col("parent").isNotNull() & F.col("__wide").isNull() & (coin(F.col("parent")) == 1) & (coin(F.col("id")) == 0), F.col("parent")).otherwise(F.col("id"))
    key = F.xxhash64(F.lit(level), mate)
    if locality:
        sizes = nodes.filter(F.col(locality).isNotNull()).groupBy(locality).agg(F.count("*").alias("__n"))
        # at most count / fragment_rows values are larger than a fragment; they stay a table
        nodes = salted_join(nodes, sizes.filter(F.col("__n") > fragment_rows), locality, "left")
        whole = F.col("__n").isNull() & F.col(locality).isNotNull()
        key = F.when(whole, F.xxhash64(F.lit("l"), locality)).otherwise(key)
    return nodes.withColumn("bucket", F.pmod(key, F.lit(buckets)))


def _solve(nodes: DataFrame, level: int, fragment_rows: int, locality: str | None) -> DataFrame:
    """(id, root, path, depth, loop) of every node of a labelled forest.

    ``nodes`` is a written table (id, parent, seg, seg_n, lo[, locality]).
    """
    count, label = nodes.agg(F.count("*"), F.max(F.length("seg"))).first()
    fragment_rows = max(1, min(fragment_rows, BUCKET_BYTES // max(FRAGMENT_BYTES, LEAST_LABELS * (label or 0))))
    buckets = _bucketed(nodes, level, count, fragment_rows, locality)
    cols = ["bucket", "id", "parent", "seg", "seg_n", "lo"]
    local = cut(buckets.select(*cols).groupBy("bucket").applyInPandas(_contract, _LOCAL).drop("bucket"))
    if count <= fragment_rows and local.filter("split").isEmpty():  # everything was local: only true roots remain
        mine = nodes.select(F.col("id").alias("exit"), F.col("seg").alias("top_seg"), F.col("seg_n").alias("top_n"))
        solved = salted_join(local, mine, "exit", "left")
        return solved.select(
            "id", F.col("exit").alias("root"),
            F.when(F.col("loop").isNull(), F.when(F.col("below") == "", F.col("top_seg")).otherwise(F.concat_ws(".", "top_seg", "below"))).alias("path"),
            F.when(F.col("loop").isNull(), F.col("top_n") + F.col("below_n")).alias("depth"),
            "loop",
        )
    # quotient links: exit -> exit of its parent, labelled with the path between
    exits = local.filter(F.col("id") == F.col("exit")).select("id", F.col("exit_parent"))
    exits = exits.join(nodes.select("id", "seg", "seg_n", "lo"), "id")
    above = local.select(
        F.col("id").alias("exit_parent"), F.col("exit").alias("up"), F.col("below").alias("up_below"),
        F.col("below_n").alias("up_n"), F.col("below_lo").alias("up_lo"), F.col("loop").alias("up_loop"), F.lit(True).alias("known"),
    )
    quotient = cut(salted_join(exits, above, "exit_parent", "left").select(
        "id", F.col("up").alias("parent"),
        F.when(F.coalesce(F.col("up_below"), F.lit("")) == "", F.col("seg")).otherwise(F.concat_ws(".", "up_below", "seg")).alias("seg"),
        (F.coalesce(F.col("up_n"), F.lit(0)) + F.col("seg_n")).alias("seg_n"),
        F.least("lo", "up_lo").alias("lo"), F.col("up_loop"),
    ))
    # only exits that others hang from need the recursion; the rest is one step
    core_ids = quotient.filter(F.col("parent").isNotNull()).select(F.col("parent").alias("id")).distinct()
    core = cut(quotient.join(core_ids, "id", "left_semi"))
    inner = core.select("id", "parent", "seg", "seg_n", "lo")
    above_solved = _solve(inner, level + 1, fragment_rows, None)
    loops = core.filter(F.col("up_loop").isNotNull()).select("id", "up_loop")
    above_solved = above_solved.join(loops.select(F.col("id").alias("root"), F.col("up_loop").alias("root_loop")), "root", "left")
    above_solved = cut(above_solved.select(
        F.col("id").alias("parent"), F.col("root").alias("p_root"), F.col("path").alias("p_path"),
        F.col("depth").alias("p_depth"), F.coalesce("loop", "root_loop").alias("p_loop"),
    ))
    heads = salted_join(quotient, above_solved, "parent", "left").select(
        F.col("id").alias("exit"), F.coalesce("p_root", F.when(F.col("parent").isNull(), F.col("id"))).alias("root"),
        F.when(F.col("p_path").isNull(), F.col("seg")).otherwise(F.concat_ws(".", "p_path", "seg")).alias("h_path"),
        (F.coalesce("p_depth", F.lit(0)) + F.col("seg_n")).alias("h_depth"),
        F.coalesce("up_loop", "p_loop").alias("h_loop"),
    )
    whole = salted_join(local, heads, "exit", "left")
    loop = F.coalesce("loop", "h_loop")
    return whole.select(
        "id", "root",
        F.when(loop.isNull(), F.when(F.col("below") == "", F.col("h_path")).otherwise(F.concat_ws(".", "h_path", "below"))).alias("path"),
        F.when(loop.isNull(), F.col("h_depth") + F.col("below_n")).alias("depth"),
        loop.alias("loop"),
    )


def hierarchy(links: DataFrame, fragment_rows: int = FRAGMENT_ROWS, locality: str | None = None) -> DataFrame:
    """Path, depth and root of every node of ``links`` (id, parent_id).

    One row per id: ``id, root_id, depth, full_path``. A root has depth 1; a
    parent that isn't an id of the table makes its child a root, and so does a
    null parent. Nodes on a loop or below one have depth 0, full_path 'cycle'
    and the least id on the loop as root. Rows with a null id are left out, an
    id given more than once must be reduced before (see ``latest_rows``);
    equal rows are taken once. An empty table gives no rows. ``locality`` may
    name a column whose values tend to hold whole trees; it only saves work.
    """
    extra = [F.col(locality).alias("__loc")] if locality else []
    base = links.filter(F.col("id").isNotNull()).select(F.col("id").cast("long").alias("id"), F.col("parent_id").cast("long").alias("parent"), *extra)
    base = base.groupBy("id").agg(F.max("parent").alias("parent"), *([F.max("__loc").alias("__loc")] if locality else []))
    nodes = cut(base.select("*", F.col("id").cast("string").alias("seg"), F.lit(1).alias("seg_n"), F.col("id").alias("lo")))
    solved = _solve(nodes, 0, fragment_rows, "__loc" if locality else None)
    return solved.select(
        "id", F.coalesce("loop", "root").alias("root_id"),
        F.coalesce("depth", F.lit(0)).cast("int").alias("depth"),
        F.coalesce("path", F.lit("cycle")).alias("full_path"),
    )


def descendants(solved: DataFrame) -> DataFrame:
    """(ancestor_id, descendant_id, distance) of every node outside loops.

    Read off the full paths, so it is a narrow stage; the rows are as many as
    the depths add up to. Nodes on or below a loop have no proper ancestors.
    """
    steps = F.split("full_path", r"\.")
    rows = solved.filter(F.col("depth") > 1).select(F.col("id").alias("descendant_id"), "depth", F.posexplode(F.slice(steps, F.lit(1), F.col("depth") - 1)).alias("pos", "up"))
    return rows.select(F.col("up").cast("long").alias("ancestor_id"), "descendant_id", (F.col("depth") - 1 - F.col("pos")).cast("int").alias("distance"))
