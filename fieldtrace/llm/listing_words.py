"""What a listing tells of its item, read off the whole corpus.

Nothing here knows a product line, a variant or the key of an attribute. Which
spec keys identify an item, which words are too common to name one, and which
common words are variants is counted over all listings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fieldtrace.llm.copies import words
from fieldtrace.runtime import cut, spread

#: A spec key identifies an item if at least this share of its values is told again in the listing's own name or short description.
TOLD_AGAIN = 0.05
#: Keys in fewer than one of so many listings are not counted, so at most as many keys times the entries of a listing exist.
KEY_SHARE = 10_000
#: A word is common if it occurs in more than one of so many contexts (brand and numbers).
COMMON_SHARE = 400
#: A word in at most so many contexts is never common, so that a small table has names at all.
NEVER_COMMON = 8
#: A variant in a title stands at most so many words from the number.
REACH = 2

# Legal forms and articles in company names.
COMPANY = ["gmbh", "ag", "kg", "ltd", "limited", "group", "company", "the", "inc", "co", "corp", "sa", "sarl", "srl", "bv", "ab", "oy", "plc", "llc", "und", "and"]
# Basic colours in English, German, French, Spanish and Italian, and their usual two-letter codes.
COLOURS = {
    "black": ["black", "schwarz", "noir", "negro", "nero", "bk"],
    "white": ["white", "weiss", "weiß", "blanc", "blanco", "bianco", "wh"],
    "red": ["red", "rot", "rouge", "rojo", "rosso", "rd"],
    "grey": ["grey", "gray", "grau", "gris", "grigio", "gy"],
    "beige": ["beige", "be"],
    "anthracite": ["anthracite", "anthrazit", "antracita", "antracite", "an"],
    "transparent": ["transparent", "clear", "tr"],
    "blue": ["blue", "blau", "bleu", "azul", "blu", "bl", "bu"],
    "green": ["green", "grün", "vert", "verde", "gn"],
    "yellow": ["yellow", "gelb", "jaune", "amarillo", "giallo", "ye"],
    "brown": ["brown", "braun", "brun", "marron", "marrone", "br", "bn"],
    "orange": ["orange", "naranja", "arancione", "og"],
    "pink": ["pink", "rosa", "pk"],
    "violet": ["violet", "violett", "purple", "lila", "viola", "vt"],
    "silver": ["silver", "silber", "argent", "plata", "argento"],
    "gold": ["gold", "golden", "doré", "oro"],
}
# Units, their kind and size in the kind's base unit, and whether they are metric.
UNITS = {
    "mm": ("length", 1.0, True), "cm": ("length", 10.0, True), "m": ("length", 1000.0, True),
    "in": ("length", 25.4, False), "inch": ("length", 25.4, False), "inches": ("length", 25.4, False), "ft": ("length", 304.8, False),
    "ml": ("volume", 1.0, True), "cl": ("volume", 10.0, True), "l": ("volume", 1000.0, True), "ltr": ("volume", 1000.0, True),
    "litre": ("volume", 1000.0, True), "liter": ("volume", 1000.0, True), "litres": ("volume", 1000.0, True), "liters": ("volume", 1000.0, True),
    "gal": ("volume", 3785.411784, False), "gallon": ("volume", 3785.411784, False), "gallons": ("volume", 3785.411784, False),
    "mg": ("weight", 0.001, True), "g": ("weight", 1.0, True), "kg": ("weight", 1000.0, True),
    "lb": ("weight", 453.59237, False), "lbs": ("weight", 453.59237, False), "oz": ("weight", 28.349523125, False),
    "w": ("power", 1.0, True), "kw": ("power", 1000.0, True), "hp": ("power", 745.69987, False),
    "v": ("voltage", 1.0, True), "kv": ("voltage", 1000.0, True), "ah": ("charge", 1.0, True), "mah": ("charge", 0.001, True),
    "nm": ("torque", 1.0, True), "bar": ("pressure", 1.0, True), "psi": ("pressure", 0.0689476, False),
}
_UNIT = "|".join(sorted(UNITS, key=len, reverse=True))
# 'in' before a word is the preposition
_MEASURE = rf"(?<![\p{{L}}\p{{N}}.,/-])(\p{{Nd}}+(?:[.,]\p{{Nd}}+)?)\s*({_UNIT})(?![\p{{L}}\p{{N}}])(?<!in(?=\s\p{{L}}))"
# a decimal mark lost as a blank: "2 5 kg"
_LOST_MARK = rf"(?<![\p{{L}}\p{{N}}.,])(\p{{Nd}}) (\p{{Nd}}) ?(kw|m|kg|l|ltr|litre|liter)(?![\p{{L}}\p{{N}}])"
_TOKEN = r"[\p{L}\p{M}\p{N}]+"
#: Blanks and marks of registration; these and other marks.
_BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000®©™"
_MARKS = _BLANKS + ".,;:!?/|\\-–—_()[]{}<>+&*#'\"’„“”·•…="
_COLOUR_OF = {w: c for c, ws in COLOURS.items() for w in ws}


def _literal_map(entries: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in entries.items() for x in kv])


def clean(text: Column) -> Column:
    """Lower case, marks of registration away, one blank between words."""
    t = F.translate(F.lower(F.coalesce(text, F.lit(""))), _BLANKS, " " * len(_BLANKS))
    return F.trim(F.regexp_replace(F.regexp_replace(t, " {2,}", " "), _LOST_MARK, "$1.$2 $3"))


def _spaced(text: Column) -> Column:
    """Lower case, every mark and blank as a blank: cheap, for counting only."""
    return F.translate(F.lower(text), _MARKS, " " * len(_MARKS))


def entries(specs: Column) -> Column:
    """array<struct<k,v>> of a JSON object's entries with one string value; empty for anything else."""
    parsed = F.try_variant_get(F.try_parse_json(specs), "$", "map<string,variant>")
    each = F.transform(F.map_entries(parsed), lambda e: F.struct(F.trim(F.translate(F.lower(e["key"]), ".:;,", "")).alias("k"), F.when(F.schema_of_variant(e["value"]) == "STRING", F.try_variant_get(e["value"], "$", "string")).alias("v")))
    return F.coalesce(F.filter(each, lambda e: e["v"].isNotNull()), F.array().cast("array<struct<k:string,v:string>>"))


def brand_key(brand: Column) -> Column:
    """Words of a brand without legal forms, joined; null where nothing is left."""
    left = F.filter(F.split(words(brand), " "), lambda w: ~w.isin(COMPANY))
    joined = F.array_join(left, "")
    return F.when(joined != "", joined)


def fields(products: DataFrame) -> DataFrame:
    """(id, brand, name, lead, e) of every listing with an id, cleaned and parsed once."""
    return products.filter("listing_id is not null").select(
        F.col("listing_id").cast("long").alias("id"), brand_key(F.col("brand")).alias("brand"), clean(F.col("product_name")).alias("name"),
        clean(F.col("short_description")).alias("lead"), entries(F.col("technical_specs")).alias("e"))


def identifying_keys(listings: DataFrame) -> tuple[list[str], list[str]]:
    """(keys that identify an item, those of them that hold colours), counted over all listings.

    A key counts if at least ``TOLD_AGAIN`` of its values stand word by word in
    the same listing's name or short description. One aggregate by key; keys in
    fewer than one of ``KEY_SHARE`` listings are left out, which bounds what
    reaches the driver.
    """
    title = F.concat(F.lit(" "), _spaced(F.concat_ws(" ", "name", "lead")), F.lit(" "))
    each = listings.filter(F.size("e") > 0).select(title.alias("title"), F.explode("e").alias("e"))
    value = F.trim(_spaced(F.col("e.v")))
    told = (value != "") & F.contains("title", F.concat(F.lit(" "), value, F.lit(" ")))
    counted = each.groupBy("e.k").agg(F.count("*").alias("n"), F.count_if(told).alias("told"), F.count_if(value.isin(list(_COLOUR_OF))).alias("colours"))
    least = listings.count() / KEY_SHARE
    kept = counted.filter((F.col("n") >= least) & (F.col("told") >= TOLD_AGAIN * F.col("n"))).collect()
    return sorted(r["k"] for r in kept), sorted(r["k"] for r in kept if 2 * r["colours"] > r["n"])


def _first_measure(text: Column) -> Column:
    return F.get(F.regexp_extract_all(text, F.lit(_MEASURE), 0), F.lit(0))


def tell(listings: DataFrame, keys: list[str], colour_keys: list[str]) -> DataFrame:
    """(id, brand, title, told, singles, size, colour): each listing taken apart, in expressions only.

    ``title`` are the words of name and short description in order without
    measures, ``told`` those of the identifying values, ``singles`` the values
    of one word. ``size`` is the first measure as written (values before short
    description before name), ``colour`` its name. Letters and digits that are
    written together are two words if there are at least five letters.
    """
    kept = F.filter("e", lambda e: e["k"].isin(keys)) if keys else F.array().cast("array<struct<k:string,v:string>>")
    known = listings.select("id", "brand", "name", "lead", kept.alias("e")).withColumn("values", F.transform("e", lambda e: clean(e["v"])))
    bare = lambda t: F.regexp_replace(F.regexp_replace(t, _MEASURE, " "), r"(?<![\p{L}\p{N}])(\p{L}{5,})(\p{Nd}{2,})(?![\p{L}\p{N}])", "$1 $2")
    split = lambda t: F.regexp_extract_all(bare(t), F.lit(_TOKEN), 0)
    joined = F.array_join("values", " ; ")
    backwards = F.array_join(F.reverse(F.split(F.regexp_replace("name", "[()]", " "), r"\s+")), " ")
    size = F.coalesce(_first_measure(joined), _first_measure(F.col("lead")), _first_measure(F.col("name")), _first_measure(backwards))
    colour_of = _literal_map(_COLOUR_OF)
    named = F.transform(F.filter("e", lambda e: e["k"].isin(colour_keys)), lambda e: words(e["v"])) if colour_keys else F.array().cast("array<string>")
    value_colour = F.get(F.filter(named, lambda v: v != ""), F.lit(0))
    tail = F.when(F.contains("lead", F.lit(",")), F.substring_index("lead", ",", -1)).otherwise("")
    last_of = lambda ws: F.try_element_at(colour_of, F.try_element_at(F.filter(ws, lambda w: w.isin(list(_COLOUR_OF))), F.lit(-1)))
    tail_colour = F.when(tail != "", last_of(F.regexp_extract_all(tail, F.lit(_TOKEN), 0)))
    colour = F.coalesce(F.try_element_at(colour_of, value_colour), value_colour, tail_colour, last_of(F.col("name_words")))
    taken = known.select("*", split(F.col("name")).alias("name_words"))
    return taken.select(
        "id", "brand", F.concat("name_words", split(F.col("lead"))).alias("title"), split(joined).alias("told"),
        F.filter("values", lambda v: v.rlike(r"^[\p{L}\p{N}]+$")).alias("singles"), size.alias("size"), colour.alias("colour"))


def common_words(told: DataFrame) -> list[str]:
    """Words in more than one of ``COMMON_SHARE`` contexts, brand and numbers making a context.

    Rows are counted exactly first: a word in few rows can't be in many
    contexts. For the others, at most ``COMMON_SHARE`` times the words of a
    listing, distinct contexts are counted by sketches of 5 % error, so that
    an item with any number of listings doesn't make its own name common.
    """
    every = F.array_distinct(F.concat("title", "told"))
    context = F.xxhash64("brand", F.array_sort(F.filter(every, lambda w: w.rlike(r"^\p{Nd}{2,}$"))))
    rows = told.select(every.alias("w"), context.alias("context"))
    n, contexts = rows.agg(F.count("*"), F.approx_count_distinct("context", 0.05)).first()
    flat = rows.select(F.explode("w").alias("w"), "context")
    often = flat.groupBy("w").agg(F.count("*").alias("n")).filter(F.col("n") > max(n / COMMON_SHARE, NEVER_COMMON)).select("w")
    spread = flat.join(F.broadcast(cut(often)), "w").groupBy("w").agg(F.approx_count_distinct("context", 0.05).alias("contexts"))
    return sorted(r["w"] for r in spread.filter(F.col("contexts") > max(contexts / COMMON_SHARE, NEVER_COMMON)).select("w").collect())


def variant_words(told: DataFrame, common: list[str]) -> list[str]:
    """Common words that stand alone as an identifying value and are no colour."""
    if not common:
        return []
    alone = told.select(F.explode("singles").alias("w")).filter(F.col("w").isin(common) & ~F.col("w").isin(list(_COLOUR_OF))).distinct()
    return sorted(r["w"] for r in alone.collect())


def size_names(told: DataFrame) -> DataFrame:
    """(size, size_key): one key for all ways to write a measure.

    A metric measure is its exact amount in the base unit. Another one is the
    metric amount, told somewhere in the corpus, that rounds to it at the
    digits it is written with; the most frequent if there are several, and its
    own amount if there is none.
    """
    m = told.filter("size is not null").groupBy("size").agg(F.count("*").alias("n"))
    number, unit = (F.regexp_extract("size", r"^([0-9.,]+)\s*(\p{L}+)$", k) for k in (1, 2))
    parts = lambda k: F.try_element_at(_literal_map({u: v[k] for u, v in UNITS.items()}), unit)
    number = F.regexp_replace(number, ",", ".")
    decimals = F.length(F.regexp_extract(number, r"\.([0-9]+)$", 1))
    half = F.lit(0.5) * F.pow(F.lit(10.0), -decimals) * parts(1)
    m = m.select("size", "n", parts(0).alias("kind"), parts(2).alias("metric"), F.round(number.cast("double") * parts(1), 6).alias("amount"), half.alias("half"))
    m = cut(m.filter("amount is not null"))
    key = lambda kind, amount: F.concat(kind, amount.cast("string"))
    metric = m.filter("metric").groupBy("kind", "amount").agg(F.sum("n").alias("n"))
    # amounts within one power of two meet; an interval reaches at most into the next
    power = lambda a: F.floor(F.log2(F.greatest(a, F.lit(1e-9))) * 8)
    other = m.filter("not metric").withColumn("low", F.col("amount") - F.col("half")).withColumn("high", F.col("amount") + F.col("half"))
    other = other.withColumn("p", F.explode(F.sequence(power(F.col("low")), power(F.col("high")))))
    meets = other.join(metric.select(F.col("kind").alias("k"), F.col("amount").alias("a"), F.col("n").alias("an"), power(F.col("amount")).alias("p2")), (F.col("kind") == F.col("k")) & (F.col("p") == F.col("p2")) & (F.col("a") >= F.col("low")) & (F.col("a") < F.col("high")))
    best = meets.groupBy("size").agg(F.max(F.struct("an", (-F.abs(F.col("a") - F.col("amount"))).alias("d"), "a"))["a"].alias("a"))
    return m.join(best, "size", "left").select("size", key(F.col("kind"), F.coalesce("a", "amount")).alias("size_key"))


def describe(products: DataFrame) -> DataFrame:
    """(id, brand, numbers, names, variant, size, colour) of every listing.

    ``numbers`` are its rare numbers; where it has none, the common ones beside
    a rare word, and else its codes of letters and digits. ``names`` are its
    rare words; a listing without numbers and names has all its words as one
    name. ``variant`` is empty if the title tells a number and no variant, null
    if it can't be told. Null and empty fields tell nothing.
    """
    listings = cut(fields(spread(products)))
    keys, colour_keys = identifying_keys(listings)
    told = cut(tell(listings, keys, colour_keys))
    common = common_words(told)
    variants = variant_words(told, common)
    is_common = (lambda w: w.isin(common)) if common else (lambda w: F.lit(False))
    is_word = lambda w: w.rlike(r"^[\p{L}\p{M}]{3,}$")
    d = told.withColumn("every", F.array_distinct(F.concat("title", "told"))).withColumn("rare", F.filter("every", lambda w: ~is_common(w)))
    d = d.withColumn("names", F.array_sort(F.filter("rare", lambda w: is_word(w) & ~w.isin(list(_COLOUR_OF)) & ~F.coalesce(F.contains("brand", w), F.lit(False)))))
    rare_numbers = F.filter("rare", lambda w: w.rlike(r"^\p{Nd}{2,}$"))
    beside = lambda i: F.exists(F.slice("title", F.greatest(F.lit(1), i), F.lit(3)), lambda w: F.array_contains("names", w))
    placed_numbers = F.filter(F.transform("title", lambda w, i: F.when(w.rlike(r"^\p{Nd}+$") & beside(i), w)), lambda w: w.isNotNull())
    codes = F.filter("rare", lambda w: w.rlike(r"\p{L}") & w.rlike(r"\p{N}"))
    numbers = F.when(F.size(rare_numbers) > 0, rare_numbers).when(F.size(placed_numbers) > 0, F.array_distinct(placed_numbers)).otherwise(codes)
    d = d.withColumn("numbers", F.array_sort(numbers))
    whole = F.array(F.concat_ws(" ", F.array_sort("every"), F.coalesce("size", F.lit(""))))
    d = d.withColumn("names", F.when(F.size("names") + F.size("numbers") > 0, F.col("names")).otherwise(whole))
    untold = F.when(F.arrays_overlap("title", "numbers"), F.lit(""))
    if variants:
        is_variant = lambda w: w.isin(variants)
        near = lambda i: F.exists(F.slice("title", F.greatest(F.lit(1), i + 1 - REACH), F.least(F.lit(2 * REACH + 1), i + 1 + REACH)), lambda w: F.array_contains("numbers", w))
        placed = F.filter(F.transform("title", lambda w, i: F.when(is_variant(w) & ((F.size("numbers") == 0) | near(i)), w)), lambda w: w.isNotNull())
        untold = F.coalesce(F.get(F.filter("singles", is_variant), F.lit(0)), F.get(placed, F.lit(0)), untold)
    d = d.withColumn("variant", untold)
    return d.join(size_names(told), "size", "left").select("id", "brand", "numbers", "names", "variant", F.col("size_key").alias("size"), "colour")
