"""Tree checks and TF-IDF ranking of texts against taxonomy leaves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fieldtrace.functions import text
from fieldtrace.operators.skew import salted_join
from fieldtrace.runtime import cut


def leaves(tree: DataFrame) -> DataFrame:
    """Nodes (id, parent_id, ...) that are nobody's parent."""
    parents = tree.filter("parent_id is not null").select(F.col("parent_id").alias("id")).distinct()
    return tree.join(parents, "id", "left_anti")


def tree_check(tree: DataFrame, solved: DataFrame, max_depth: int = 64) -> DataFrame:
    """(problem, nodes): repeated ids, unknown parents, loops, excessive depth.

    ``tree``: raw rows (id, parent_id); ``solved``: their hierarchy.
    """
    ids = tree.select("id").distinct()
    repeated = tree.groupBy("id").count().filter("count > 1").agg(F.count("*").alias("nodes")).select(F.lit("repeated_id").alias("problem"), "nodes")
    orphan = tree.filter("parent_id is not null").select("id", F.col("parent_id").alias("p")).join(ids.withColumnRenamed("id", "p"), "p", "left_anti").agg(F.countDistinct("id").alias("nodes")).select(F.lit("unknown_parent").alias("problem"), "nodes")
    loop = solved.agg(F.count_if(F.col("full_path") == "cycle").alias("nodes")).select(F.lit("cycle").alias("problem"), "nodes")
    deep = solved.agg(F.count_if(F.col("depth") > max_depth).alias("nodes")).select(F.lit("too_deep").alias("problem"), "nodes")
    return repeated.unionByName(orphan).unionByName(loop).unionByName(deep)


def path_names(nodes: DataFrame, solved: DataFrame) -> DataFrame:
    """(id, name_path): the names from root to node joined by ' > '."""
    steps = solved.filter("depth > 0").select("id", F.posexplode(F.split("full_path", r"\.")).alias("pos", "step"))
    named = steps.join(nodes.select(F.col("id").cast("string").alias("step"), F.coalesce("name", F.lit("")).alias("name")), "step")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "name")))  # as many as the node is deep
    return named.groupBy("id").agg(F.array_join(F.transform(ordered, lambda s: s["name"]), " > ").alias("name_path"))


def token_counts(docs: DataFrame, key: str, column: Column) -> DataFrame:
    """(key, token, tf) of every distinct token of every text."""
    return docs.select(key, F.explode(text.word_list(column)).alias("token")).groupBy(key, "token").agg(F.count("*").alias("tf"))


def idf(counts: DataFrame, documents: int) -> DataFrame:
    """(token, df, idf) with idf = ln((1 + N) / (1 + df)) + 1."""
    told = counts.groupBy("token").agg(F.count("*").alias("df"))
    return told.withColumn("idf", F.log((1 + F.lit(documents)) / (1 + F.col("df"))) + 1)


def rank(queries: DataFrame, query_key: str, query_text: str, leaf_texts: DataFrame, limit: int = 10, fill: bool = True) -> DataFrame:
    """(query, leaf_id, similarity, rank): the best leaves by cosine.

    ``leaf_texts``: (leaf_id, text). Queries meet leaves only on shared tokens:
    an equality join and a partial sum, never all pairs; hot tokens are spread.
    Ties go to the least leaf id. With ``fill`` every query has ``limit``
    candidates as long as there are so many leaves: those that share no token
    follow with similarity 0, least ids first. Without, they have no rows.
    """
    docs = token_counts(leaf_texts, "leaf_id", F.col("text"))
    weights = idf(docs, leaf_texts.count())
    d = docs.join(weights, "token").select("leaf_id", "token", (F.col("tf") * F.col("idf")).alias("w"))
    norms = d.groupBy("leaf_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("leaf_norm"))
    q = token_counts(queries, query_key, F.col(query_text)).join(weights.select("token", "idf"), "token").select(query_key, "token", (F.col("tf") * F.col("idf")).alias("qw"))
    q_norms = q.groupBy(query_key).agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("query_norm"))
    dots = salted_join(q, d, "token", "inner").groupBy(query_key, "leaf_id").agg(F.sum(F.col("qw") * F.col("w")).alias("dot"))
    scored = dots.join(norms, "leaf_id").join(q_norms, query_key).withColumn("similarity", F.round(F.col("dot") / (F.col("leaf_norm") * F.col("query_norm")), 6))
    scored = scored.select(query_key, "leaf_id", "similarity")
    if fill:
        scored = cut(scored)
        # of the first 2 * limit leaves at most limit - 1 can be candidates already
        first = sorted(r["leaf_id"] for r in leaf_texts.select("leaf_id").orderBy("leaf_id").limit(2 * limit).collect())
        full = scored.groupBy(query_key).agg(F.count("*").alias("__n")).filter(F.col("__n") >= limit)
        lacking = queries.select(query_key).join(full, query_key, "left_anti").withColumn("leaf_id", F.explode(F.array(*[F.lit(x) for x in first]))) if first else None
        if lacking is not None:
            rest = lacking.join(scored.select(query_key, "leaf_id"), [query_key, "leaf_id"], "left_anti").withColumn("similarity", F.lit(0.0))
            scored = scored.unionByName(rest)
    w = Window.partitionBy(query_key).orderBy(F.desc("similarity"), "leaf_id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).select(query_key, "leaf_id", "similarity", "rank")
