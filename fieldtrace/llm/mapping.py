"""Freely typed values mapped to a list of agreed names, in SQL expressions only.

A typed value is read as it stands; where that means nothing exactly, it is
also reduced to the letters of its last path segment, without codes and filler
words. What doesn't equal a name, an alias or a known way of
writing one (word order, abbreviated words) goes through a pigeonhole join:
a reference string is cut into k+1 segments; within k edits at least one
segment survives unchanged and at most k places away, so an equality join on
substrings and their places finds every candidate. The built-in levenshtein verifies
them; an anti-join reports what is left.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from fieldtrace.operators.skew import salted_join
from fieldtrace.runtime import cut

#: Words that sellers put before or after a name.
FILLERS = ["all", "various", "etc", "new", "sale", "sales", "misc", "home", "shop", "catalogue", "departments"]
#: Longest reference key that is sought within so many edits. Two slips are
#: meant to be found in long keys, and swapping two letters counts as two edits.
EDITS = [(9, 2), (10_000, 4)]
#: Keys up to this length allow one slip: one edit, or two that swap letters.
ONE_SLIP = 9
_PATH_SEPARATORS = r"[>/|»]"
_CODES = r"\[[^\]]*\]|[0-9]+\s*[-.:]\s*[0-9]+\s*:?|[0-9]+"


def edits(length: Column) -> Column:
    """Number of edits k that a reference key of this length allows."""
    return reduce(lambda e, lk: F.when(length <= lk[0], lk[1]).otherwise(e), reversed(EDITS[:-1]), F.lit(EDITS[-1][1]))


def _plain(text: Column) -> Column:
    """Lower case, entities decoded, '&' spelled out, one blank between words."""
    t = F.lower(text)
    t = F.regexp_replace(t, "&nbsp;", " ")
    t = F.regexp_replace(t, "&amp;|&", "and")
    return t


def typed_words(text: Column, kept_fillers: list[str] | None = None) -> Column:
    """Words of the last path segment of a typed value, codes and fillers dropped.

    A word keeps a final dot, the mark of an abbreviation. ``kept_fillers`` are
    not dropped.
    """
    fillers = [f for f in FILLERS if f not in (kept_fillers or [])]
    t = F.regexp_replace(_plain(text), _CODES, " ")
    segments = F.filter(F.split(t, _PATH_SEPARATORS), lambda s: s.rlike(r"\p{L}"))
    last = F.coalesce(F.try_element_at(segments, F.lit(-1)), F.lit(""))
    last = F.regexp_replace(last, r"etc\.?[^\p{L}]*$", " ")  # also where it is glued to the name
    found = F.regexp_extract_all(last, F.lit(r"(\p{L}[\p{L}\p{M}]*\.?)"), 1)
    bare = lambda w: F.regexp_replace(w, r"\.$", "")
    filler = lambda w: bare(w).isin(fillers) | ((F.length(bare(w)) >= 6) & (F.levenshtein(bare(w), F.lit("various")) <= 2))
    kept = F.filter(found, lambda w: ~filler(w))
    # a filler may be glued to the name
    return F.transform(kept, lambda w: F.when((F.length(w) > 8) & w.startswith("various"), F.substring(w, 8, 1000)).otherwise(w))


def full_words(text: Column) -> Column:
    """All words of a typed value as it stands, with digits."""
    return F.regexp_extract_all(_plain(text), F.lit(r"([\p{L}\p{N}][\p{L}\p{M}\p{N}]*\.?)"), 1)


def few_slips(typed: Column, ref: Column, d: Column) -> Column:
    """Whether ``d`` edits are few enough: in a short key one, or two that only swap letters."""
    letters = lambda c: F.array_sort(F.split(c, ""))
    return (F.length(ref) > ONE_SLIP) | (d <= 1) | ((d == 2) & (letters(typed) == letters(ref)))


def reference_keys(canonical: DataFrame) -> DataFrame:
    """(level, key, canon_id, whole) of every way to write a reference entry.

    Names and aliases in any rotation of their words, also with one or two
    words abbreviated to a prefix and a dot, with the second or all inner words
    left out after an abbreviated first, or cut off after eight letters or more
    (``whole`` is false). A key that
    means several entries of one level is dropped.
    """
    texts = canonical.select("level", F.col("canon_id").cast("int").alias("canon_id"), F.explode(F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("text"))
    found = F.regexp_extract_all(_plain(F.col("text")), F.lit(r"([\p{L}\p{N}][\p{L}\p{M}\p{N}]*)"), 1)
    base = texts.filter("text is not null").withColumn("w", found).withColumn("n", F.size("w")).filter("n > 0")
    turned = base.withColumn("r", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    turn = lambda a: F.concat(F.slice(a, F.col("r") + 1, F.col("n")), F.slice(a, F.lit(1), F.col("r")))
    plain = turned.select("level", "canon_id", F.array_join(turn(F.col("w")), "").alias("key"), F.lit(True).alias("whole"))
    at = base.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n")))).withColumn("word", F.element_at("w", F.col("i")))
    at = at.filter(F.length("word") >= 3).withColumn("cut", F.explode(F.sequence(F.lit(2), F.length("word"))))
    short = F.concat(F.col("word").substr(F.lit(1), F.col("cut")), F.lit("."))
    one = at.withColumn("w2", F.concat(F.slice("w", F.lit(1), F.col("i") - 1), F.array(short), F.slice("w", F.col("i") + 1, F.col("n"))))
    skip = at.filter("i = 1 and n >= 3").withColumn("w2", F.array(short, F.element_at("w", F.col("n"))))
    second = at.filter("i = 1 and n >= 4").withColumn("w2", F.concat(F.array(short), F.slice("w", F.lit(3), F.col("n"))))
    lone = at.filter("i = 1 and n >= 2 and cut >= 5").withColumn("w2", F.array(short))
    whole_key = F.array_join("w", "")
    off = base.filter("n >= 2").withColumn("cut", F.explode(F.sequence(F.lit(8), F.greatest(F.lit(8), F.length(whole_key) - 1)))).withColumn("w2", F.array(F.concat(F.substring(whole_key, F.lit(1), F.col("cut")), F.lit("."))))
    again = one.filter("cut < length(word)").withColumn("i2", F.explode(F.sequence(F.lit(1), F.col("n")))).filter("i2 > i")
    again = again.withColumn("word2", F.element_at("w", F.col("i2"))).filter(F.length("word2") >= 4).withColumn("cut2", F.explode(F.sequence(F.lit(3), F.length("word2") - 1)))
    short2 = F.concat(F.col("word2").substr(F.lit(1), F.col("cut2")), F.lit("."))
    two = again.withColumn("w2", F.concat(F.slice("w2", F.lit(1), F.col("i2") - 1), F.array(short2), F.slice("w2", F.col("i2") + 1, F.col("n"))))
    cols = ["level", "canon_id", "w2"]
    dotted = one.select(*cols).unionByName(skip.select(*cols)).unionByName(second.select(*cols)).unionByName(lone.select(*cols)).unionByName(off.select(*cols)).unionByName(two.select(*cols)).withColumn("n", F.size("w2")).withColumn("r", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    dotted = dotted.select("level", "canon_id", F.array_join(turn(F.col("w2")), "").alias("key"), F.lit(False).alias("whole"))
    every = plain.unionByName(dotted).groupBy("level", "key", "canon_id").agg(F.max("whole").alias("whole"))
    meant = every.groupBy("level", "key").agg(F.count("*").alias("n"), F.min("canon_id").alias("canon_id"), F.max("whole").alias("whole"))
    return meant.filter("n = 1").select("level", "key", "canon_id", "whole")


def _segments(keys: DataFrame) -> DataFrame:
    """k+1 segments of every reference key: (level, key, canon_id, k, at, segment)."""
    # an abbreviation leaves less to go by: one edit less, two at most
    k = F.when(F.col("whole"), edits(F.length("key"))).otherwise(F.greatest(F.lit(0), F.least(F.lit(2), edits(F.length("key")) - 1)))
    sized = keys.withColumn("k", k).filter("k > 0").withColumn("n", F.length("key"))
    cut_at = lambda j: F.floor(F.col("n") * j / (F.col("k") + 1)).cast("int")
    parts = sized.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k"))))
    return parts.select("level", (~F.col("whole")).alias("dotted"), F.col("key").alias("ref"), "canon_id", "k", "n", cut_at(F.col("j")).alias("at"),
                        F.col("key").substr(cut_at(F.col("j")) + 1, cut_at(F.col("j") + 1) - cut_at(F.col("j"))).alias("segment"))


def closest(typed: DataFrame, keys: DataFrame) -> DataFrame:
    """(level, key, canon_id, d) of typed keys within k edits of a reference key.

    Abbreviated keys are held against abbreviated references, others against
    whole ones. The closest reference wins; keys equally close to several entries of the
    level are left unmatched.
    """
    shifts = F.explode(F.sequence(F.greatest(F.lit(0), F.col("at") - F.col("k")), F.col("at") + F.col("k")))
    segments = cut(_segments(keys).withColumn("q_at", shifts))  # each segment at all places it may have moved to
    lens = sorted(r[0] for r in segments.select(F.length("segment")).distinct().collect())  # at most the longest name's length
    if not lens:
        return typed.select("level", "key", F.lit(0).alias("canon_id"), F.lit(0).alias("d")).limit(0)
    places = lambda n: F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("key") - (n - 1)))
    piece = lambda n: lambda p: F.struct((p - 1).alias("at"), F.col("key").substr(p, F.lit(n)).alias("segment"))
    subs = F.flatten(F.array(*[F.transform(places(n), piece(n)) for n in lens]))
    pieces = typed.select("level", "key", F.explode(subs).alias("s")).select("level", "key", F.col("key").contains(".").alias("dotted"), F.col("s.at").alias("q_at"), F.col("s.segment").alias("segment"))
    near = pieces.join(segments, ["level", "dotted", "segment", "q_at"]).filter(F.abs(F.length("key") - F.col("n")) <= F.col("k"))
    pairs = near.select("level", "key", "ref", "canon_id", "k").distinct()
    verified = pairs.withColumn("d", F.levenshtein("key", "ref")).filter((F.col("d") <= F.col("k")) & few_slips(F.col("key"), F.col("ref"), F.col("d")))
    best = verified.groupBy("level", "key", "canon_id").agg(F.min("d").alias("d"))
    told = best.groupBy("level", "key").agg(F.min(F.struct("d", "canon_id")).alias("b"), F.collect_list("d").alias("all"))
    return told.filter(F.size(F.filter("all", lambda d: d == F.col("b.d"))) == 1).select("level", "key", F.col("b.canon_id").alias("canon_id"), F.col("b.d").alias("d"))


def map_values(values: DataFrame, canonical: DataFrame) -> DataFrame:
    """(level, value, canon_id, matched_by, distance) of every distinct typed value.

    ``values``: (level, value), ``canonical``: (canon_id, name, level,
    aliases). Null and blank values and exact names of their level are left
    out. What a value means as it stands goes before what is left of it without
    codes and fillers; ``distance`` counts edits. A value that means no entry has canon_id 0; those come from an
    anti-join. Values of a level without entries are all unmatched; empty
    tables give no rows.
    """
    blank = ~F.col("value").rlike(r"(?U)[^\s\x1c-\x1f]")
    names = canonical.select("level", F.col("name").alias("value"))
    distinct = values.filter(F.col("value").isNotNull() & ~blank).distinct().join(names, ["level", "value"], "left_anti")
    joined = F.array_join(typed_words(F.col("value")), "")
    # 'u.' may stand for 'and' or end an abbreviation: both are tried
    full = F.array_join(full_words(F.col("value")), "")
    named = canonical.select(F.explode(full_words(F.concat_ws(" ", "name", F.array_join("aliases", " ")))).alias("w")).filter(F.col("w").isin(FILLERS)).distinct()
    own = sorted(r["w"] for r in named.collect())  # fillers that are words of a name: at most all fillers
    keys_told = [full, joined, F.regexp_replace(joined, r"u\.", "and")] + ([F.array_join(typed_words(F.col("value"), own), "")] if own else [])
    ways = F.array(*[F.struct(F.lit(n).alias("way"), k.alias("key")) for n, k in enumerate(keys_told)])
    typed = cut(distinct.withColumn("w", F.explode(ways)).select("level", "value", "w.way", "w.key").filter("key != ''"))
    keys = cut(reference_keys(canonical))
    exact = typed.join(keys.select("level", "key", "canon_id"), ["level", "key"]).withColumn("d", F.lit(0))
    first = lambda df: df.groupBy("level", "value").agg(F.min(F.struct("d", "way", "canon_id")).alias("b")).select("level", "value", "b.canon_id", "b.d")
    known = cut(first(exact))
    rest = cut(typed.join(known, ["level", "value"], "left_anti"))
    near = closest(rest.select("level", "key").distinct(), keys)
    hit = cut(known.unionByName(first(rest.join(near, ["level", "key"]))))
    hit = hit.select("level", "value", "canon_id", F.when(F.col("d") == 0, "key").otherwise("edits").alias("matched_by"), F.col("d").alias("distance"))
    missed = distinct.join(hit, ["level", "value"], "left_anti").select("level", "value", F.lit(0).alias("canon_id"), F.lit("none").alias("matched_by"), F.lit(None).cast("int").alias("distance"))
    return hit.unionByName(missed)


def map_records(records: DataFrame, id_col: str, fields: list[str], canonical: DataFrame) -> DataFrame:
    """(id, field_name, canon_id) of every typed value of ``fields``."""
    each = F.array(*[F.struct(F.lit(f).alias("level"), F.col(f).alias("value")) for f in fields])
    long = records.select(F.col(id_col).alias("id"), F.explode(each).alias("e")).select("id", "e.level", "e.value").filter("value is not null")
    mapped = cut(map_values(long.select("level", "value"), canonical))
    keyed = long.withColumn("lv", F.concat_ws("\x01", "level", "value")).select("id", "level", "lv")
    found = salted_join(keyed, mapped.select(F.concat_ws("\x01", "level", "value").alias("lv"), "canon_id"), "lv", "inner")
    return found.select(F.col("id").alias(id_col), F.col("level").alias("field_name"), "canon_id")


def unmatched(records: DataFrame, fields: list[str], canonical: DataFrame) -> DataFrame:
    """(field_name, value, records): values without an entry and how often they occur."""
    each = F.array(*[F.struct(F.lit(f).alias("level"), F.col(f).alias("value")) for f in fields])
    counts = records.select(F.explode(each).alias("e")).groupBy("e.level", "e.value").agg(F.count("*").alias("records"))
    missed = map_values(counts.select("level", "value"), canonical).filter("canon_id = 0")
    return counts.join(missed.select("level", "value"), ["level", "value"]).select(F.col("level").alias("field_name"), "value", "records")
