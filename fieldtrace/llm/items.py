"""Product listings that describe the same item, whoever sells it.

A listing's rare words and numbers, read off the whole corpus, are its tokens;
brand, variant, size and colour are told beside them. Word tokens carry the
number they stand with and are joined over prefixes in order of rarity.
Candidates that pass the length and positional filters are verified: no told
attribute may differ, and the letter pairs of their words must contain each
other by weight. Stars of verified sets around the best supported writing are
the items. A star that leaves some of variant, size and colour untold then
joins the star that tells them, where only one told value fits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fieldtrace.llm.listing_words import describe
from fieldtrace.operators.skew import salted_join
from fieldtrace.runtime import cut

#: Least shared weight, as a part of the lighter set's weight.
CONTAINMENT = 0.7
#: The same for the word tokens of a candidate pair: one word may be misspelt if the brand is told.
CANDIDATE = 0.4
#: Weights of a word token and of the brand; in the verification a pair of letters weighs 1.
WORD_WEIGHT, BRAND_WEIGHT = 3, 2
#: What a listing may leave untold.
ATTRIBUTES = ("variant", "size", "colour")


def letter_pairs(names: Column) -> Column:
    """The distinct pairs of neighbouring letters of all words, with marks at their ends."""
    pairs = F.transform(names, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.concat(F.lit("^"), w, F.lit("$")).substr(i, F.lit(2))))
    return F.array_distinct(F.flatten(pairs))


def token_sets(described: DataFrame) -> DataFrame:
    """One row per distinct description, with its tokens, their weight and its support.

    A token is a word or the brand together with a number the listing tells,
    or without one where it tells none.
    """
    one = described.groupBy("set", "brand", "numbers", "names", *ATTRIBUTES).agg(F.count("*").alias("support"))
    places = F.when(F.size("numbers") > 0, F.col("numbers")).otherwise(F.array(F.lit("")))
    kinds = F.concat(F.transform("names", lambda w: F.struct(w.alias("word"), F.lit(WORD_WEIGHT).alias("w"))),
                     F.when(F.col("brand").isNotNull() & (F.size("numbers") > 0), F.array(F.struct(F.concat(F.lit(" "), F.col("brand")).alias("word"), F.lit(BRAND_WEIGHT).alias("w")))).otherwise(F.array().cast("array<struct<word:string,w:int>>")))
    kinds = F.when(F.size(kinds) > 0, kinds).otherwise(F.array(F.struct(F.lit("").alias("word"), F.lit(1).alias("w"))))
    tokens = F.flatten(F.transform(places, lambda p: F.transform(kinds, lambda k: F.struct(F.xxhash64(p, k["word"]).alias("token"), k["w"].alias("w")))))
    return one.withColumn("tokens", tokens).withColumn("weight", F.aggregate("tokens", F.lit(0), lambda a, t: a + t["w"]))


def _with_set(described: DataFrame) -> DataFrame:
    nothing = [F.coalesce(c, F.lit("\x01")) for c in ("brand", *ATTRIBUTES)]
    return described.withColumn("set", F.xxhash64(F.array_join("numbers", " "), F.array_join("names", "\x02"), *nothing))


def _ranked(sets: DataFrame) -> DataFrame:
    """(set, weight, token, w, after): tokens in order of rarity; ``after`` is the weight of those behind."""
    flat = sets.select("set", "weight", F.explode("tokens").alias("t")).select("set", "weight", "t.token", "t.w")
    rarity = flat.groupBy("token").agg(F.count("*").alias("df"))
    known = salted_join(flat, rarity, "token", "inner")
    order = known.groupBy("set", "weight").agg(F.array_sort(F.collect_list(F.struct("df", "token", "w"))).alias("o"))  # as many as the set has tokens
    placed = order.select("set", "weight", "o", F.posexplode("o").alias("pos", "t"))
    after = F.aggregate(F.slice("o", F.col("pos") + 2, F.size("o")), F.lit(0), lambda a, t: a + t["w"])
    return placed.select("set", "weight", F.col("t.token").alias("token"), F.col("t.w").alias("w"), after.alias("after"))


def contained(a: dict, b: dict, containment: float = CONTAINMENT) -> Column:
    """Exact weighted containment of two sets' letter pairs and brands; two different brands never match."""
    shared = F.size(F.array_intersect(a["pairs"], b["pairs"])) + F.when(a["brand"] == b["brand"], BRAND_WEIGHT).otherwise(0)
    weigh = lambda s: F.size(s["pairs"]) + F.when(s["brand"].isNotNull(), BRAND_WEIGHT).otherwise(0)
    return (shared >= F.lit(containment) * F.least(weigh(a), weigh(b)) - 1e-9) & F.coalesce(a["brand"] == b["brand"], F.lit(True))


def similar_sets(sets: DataFrame, containment: float = CONTAINMENT, candidate: float = CANDIDATE) -> DataFrame:
    """(a, b) of all sets that contain each other well enough, a < b.

    Of two sets the lighter one must share ``candidate`` of its own weight, so
    it shares a token before the rest of its tokens, in order of rarity, falls
    below that (prefix filter); the partner may hold it anywhere and weighs at
    least as much (length filter); the shared token and the lesser rest behind
    it must reach that weight (positional filter). The tokens of the first
    match decide, so no pair comes twice. Numbers, variant, size and colour
    must agree, untold only with untold.
    """
    ranked = cut(_ranked(sets))
    bar = F.lit(candidate) * F.col("weight") - 1e-9
    light = ranked.filter(F.col("after") + F.col("w") >= bar).select(F.col("set").alias("x"), F.col("weight").alias("wx"), "w", F.col("after").alias("after_x"), "token")
    heavy = ranked.select(F.col("set").alias("y"), F.col("weight").alias("wy"), F.col("after").alias("after_y"), "token")
    near = salted_join(light, heavy, "token", "inner").filter((F.col("wx") < F.col("wy")) | ((F.col("wx") == F.col("wy")) & (F.col("x") < F.col("y"))))
    near = near.filter(F.col("w") + F.least("after_x", "after_y") >= F.lit(candidate) * F.col("wx") - 1e-9)
    pairs = near.select("x", "y").distinct()
    told = sets.select("set", F.struct("brand", "numbers", *ATTRIBUTES, letter_pairs(F.col("names")).alias("pairs")).alias("told"))
    full = pairs.join(told.select(F.col("set").alias("x"), F.col("told").alias("tx")), "x").join(told.select(F.col("set").alias("y"), F.col("told").alias("ty")), "y")
    x, y = F.col("tx"), F.col("ty")
    same = F.arrays_overlap(x["numbers"], y["numbers"]) | (F.size(x["numbers"]) + F.size(y["numbers"]) == 0)
    for c in ATTRIBUTES:
        same = same & x[c].eqNullSafe(y[c])
    return full.filter(same & contained(x, y, containment)).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def star_clusters(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """(set, centre): stars around the best supported sets.

    A set better supported than all its open neighbours (ties: least hash)
    becomes a centre and takes its open neighbours, each by its best centre;
    this repeats until no edge is left; the best supported open set is a centre
    in every round, so it ends. Sets without neighbours are their own centre.
    """
    rank = sets.select("set", "support")
    both = pairs.select(F.col("a").alias("set"), F.col("b").alias("near")).unionByName(pairs.select(F.col("b").alias("set"), F.col("a").alias("near")))
    edges = cut(both.join(rank.withColumnRenamed("set", "near").withColumnRenamed("support", "near_support"), "near").join(rank, "set"))
    better = (F.col("near_support") > F.col("support")) | ((F.col("near_support") == F.col("support")) & (F.col("near") < F.col("set")))
    done = []
    while edges.take(1):
        marked = edges.groupBy("set").agg(F.max(better.cast("int")).alias("beaten"))
        centres = cut(marked.filter("beaten = 0").select("set"))
        taken = edges.join(centres.withColumnRenamed("set", "near"), "near", "left_semi").groupBy("set").agg(F.max(F.struct("near_support", (-F.col("near")).alias("least")))["least"].alias("c"))
        taken = cut(taken.select("set", (-F.col("c")).alias("centre")))
        done.append(taken)
        gone = centres.unionByName(taken.select("set"))
        edges = cut(edges.join(gone, "set", "left_anti").join(gone.withColumnRenamed("set", "near"), "near", "left_anti"))
    if not done:
        return sets.select("set", F.col("set").alias("centre"))
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    return sets.select("set").join(every, "set", "left").select("set", F.coalesce("centre", "set").alias("centre"))


def fill_untold(sets: DataFrame, clusters: DataFrame) -> DataFrame:
    """(set, centre) after stars with untold attributes joined those that tell them.

    A star fits one of similar words, a common number and no other known brand
    that agrees in all attributes the first tells and tells at least one more.
    If all that fit give one value at most for each attribute, it joins the one
    that tells most (then the best supported); otherwise it stays apart.
    """
    rows = cut(sets.join(clusters, "set").select("centre", "support", "brand", "numbers", letter_pairs(F.col("names")).alias("pairs"), *ATTRIBUTES))
    every = lambda names, told: F.lit(True) if not names else F.expr(" and ".join(f"{a} is {'not ' * told}null" for a in names))
    ways = [[a for k, a in enumerate(ATTRIBUTES) if way >> k & 1] for way in range(1, 2 ** len(ATTRIBUTES))]
    rest = lambda way: [a for a in ATTRIBUTES if a not in way]
    places = rows.withColumn("number", F.explode(F.when(F.size("numbers") > 0, F.col("numbers")).otherwise(F.array(F.lit("")))))
    # a way is the set of attributes left untold; what is told must be equal and is part of the key
    key = lambda k, way: F.xxhash64(F.lit(k), "number", *[F.col(a) for a in rest(way)])
    fits = lambda way, is_open: every(rest(way), True) & (every(way, False) if is_open else ~every(way, False))
    sided = lambda is_open: places.withColumn("held", F.explode(F.filter(F.array(*[F.when(fits(way, is_open), key(k, way)) for k, way in enumerate(ways)]), lambda h: h.isNotNull())))
    told = F.struct("centre", "support", "brand", "pairs", *ATTRIBUTES)
    untold, full = sided(True).select("held", told.alias("x")), sided(False).select("held", told.alias("y"))
    fit = salted_join(full, untold, "held", "inner").filter(contained(F.col("x"), F.col("y")))
    fit = fit.select(F.col("x.centre").alias("centre"), F.col("y.centre").alias("to"), F.col("y.support").alias("support"), *[F.col(f"y.{a}").alias(a) for a in ATTRIBUTES])
    tells = sum((F.col(a).isNotNull().cast("int") for a in ATTRIBUTES), F.lit(0))
    best = F.max(F.struct(tells.alias("tells"), "support", (-F.col("to")).alias("least"), "to"))["to"].alias("to")
    one = F.expr(" and ".join(f"(low_{a} is null or low_{a} = high_{a})" for a in ATTRIBUTES))
    moved = fit.groupBy("centre").agg(best, *[f(a).alias(f"{n}_{a}") for a in ATTRIBUTES for f, n in ((F.min, "low"), (F.max, "high"))]).filter(one)
    moved = cut(moved.select("centre", "to"))
    for _ in ATTRIBUTES[1:]:  # each step tells one attribute more
        further = moved.select(F.col("centre").alias("to"), F.col("to").alias("further"))
        moved = moved.join(further, "to", "left").select("centre", F.coalesce("further", "to").alias("to"))
    return clusters.join(moved, "centre", "left").select("set", F.coalesce("to", "centre").alias("centre"))


def same_items(products: DataFrame) -> DataFrame:
    """(listing_id, item) of every listing; item names its group.

    Every listing takes part: by its rare words and numbers, else by its codes,
    else by all its words at once. Rows with a null listing_id are left out;
    null and empty fields tell nothing; listings that tell nothing at all are
    items of their own; an empty table gives no rows.
    """
    described = cut(_with_set(describe(products)))
    sets = cut(token_sets(described))
    clusters = cut(fill_untold(sets, cut(star_clusters(sets, cut(similar_sets(sets))))))
    empty = (F.size("numbers") == 0) & (F.trim(F.array_join("names", "")) == "")
    keyed = described.select("id", F.when(~empty, F.col("set")).alias("set"))
    named = salted_join(keyed, clusters, "set", "left")
    return named.select(F.col("id").alias("listing_id"), F.coalesce(F.concat(F.lit("i"), F.col("centre")), F.concat(F.lit("l"), F.col("id"))).alias("item"))


#: Listings of one item in a block; pairs are made between two blocks at a time.
BLOCK = 2_000


def item_pairs(items: DataFrame, block: int = BLOCK) -> DataFrame:
    """(listing_id_a, listing_id_b), a < b, of all listings of one item.

    The listings of an item are dealt to blocks of about ``block``; each pair
    of blocks is one unit of work, so no task makes more than block^2 pairs of
    one item, however large it is.
    """
    grouped = cut(items.select("listing_id", "item"))
    sizes = grouped.groupBy("item").agg(F.count("*").alias("n")).filter("n > 1").select("item", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    dealt = salted_join(grouped, sizes, "item", "inner").withColumn("block", F.pmod(F.xxhash64("listing_id"), F.col("blocks")).cast("int"))
    left = dealt.select(F.col("listing_id").alias("listing_id_a"), "item", F.col("block").alias("i"), F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)).alias("j"))
    right = dealt.select(F.col("listing_id").alias("listing_id_b"), "item", F.col("block").alias("j"), F.explode(F.sequence(F.lit(0), F.col("block"))).alias("i"))
    both = left.join(right, ["item", "i", "j"]).filter((F.col("i") != F.col("j")) | (F.col("listing_id_a") < F.col("listing_id_b")))
    return both.select(F.least("listing_id_a", "listing_id_b").alias("listing_id_a"), F.greatest("listing_id_a", "listing_id_b").alias("listing_id_b"))
