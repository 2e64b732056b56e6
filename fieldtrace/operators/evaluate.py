"""Calibration and selective-classification metrics over probability maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fieldtrace.runtime import cut

TEMPERATURES = [0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 5.0, 8.0]
Z95 = 1.959963984540054
CLAMP = 1e-12


def wilson_lower(correct: Column, accepted: Column, z: float = Z95) -> Column:
    """Lower bound of a binomial share; 0 without trials."""
    n = accepted.cast("double")
    p = correct / n
    bound = (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    return F.when(accepted > 0, bound).otherwise(0.0)


def rescale(probabilities: Column, temperature: Column | float) -> Column:
    """Softmax of log probabilities over the temperature, as a new map.

    exp(ln p / t) is p to the power 1/t; clamped probabilities keep it away
    from underflow, so no maximum has to be taken out.
    """
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    powers = F.transform_values(probabilities, lambda k, v: F.pow(F.greatest(v, F.lit(CLAMP)), 1 / t))
    entries = F.map_entries(powers)
    total = F.aggregate(entries, F.lit(0.0), lambda a, e: a + e["value"])
    shares = F.zip_with(entries, F.array_repeat(total, F.size(entries)), lambda e, z: F.struct(e["key"].alias("key"), (e["value"] / z).alias("value")))
    return F.map_from_entries(shares)


def winner(probabilities: Column) -> Column:
    """Class of the greatest probability; ties go to the least key."""
    ranked = F.array_sort(F.transform(F.map_entries(probabilities), lambda e: F.struct((-e["value"]).alias("p"), e["key"].alias("k"))))
    return F.get(ranked, F.lit(0))["k"]


def valid_probabilities(probabilities: Column) -> Column:
    """Finite, between 0 and 1, and summing to 1 within 0.002."""
    values = F.map_values(probabilities)
    inside = F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v <= 1))
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    return inside & (F.abs(total - 1) <= 0.002)


def judged(predictions: DataFrame, temperature: float = 1.0) -> DataFrame:
    """Predictions (label, probabilities) with rescaled map, choice, confidence, hit."""
    scaled = predictions.withColumn("p", rescale(F.col("probabilities"), temperature))
    chosen = scaled.withColumn("chosen", winner(F.col("p")))
    return chosen.withColumn("confidence", F.try_element_at("p", F.col("chosen"))).withColumn("hit", (F.col("chosen") == F.col("label")).cast("int"))


def confusion(rows: DataFrame) -> DataFrame:
    """(class, tp, fp, fn) for every label or chosen class, from (label, chosen)."""
    counts = rows.groupBy("label", "chosen").agg(F.count("*").alias("n"))  # classes squared at most
    side = F.explode(F.array(
        F.struct(F.col("label").alias("class"), F.when(F.col("label") == F.col("chosen"), F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("long").alias("fp"), F.when(F.col("label") != F.col("chosen"), F.col("n")).otherwise(0).alias("fn")),
        F.struct(F.col("chosen").alias("class"), F.lit(0).cast("long").alias("tp"), F.when(F.col("label") != F.col("chosen"), F.col("n")).otherwise(0).alias("fp"), F.lit(0).cast("long").alias("fn"))))
    return counts.select(side.alias("s")).select("s.*").groupBy("class").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))


def macro_f1(conf: DataFrame) -> DataFrame:
    f1 = 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return conf.agg(F.avg(f1).alias("macro_f1"))


def expected_calibration_error(rows: DataFrame) -> DataFrame:
    """ECE over ten equal bins of (confidence, hit)."""
    bins = rows.groupBy(F.least(F.lit(9), F.floor(F.col("confidence") * 10)).alias("bin")).agg(F.count("*").alias("n"), F.avg("confidence").alias("conf"), F.avg("hit").alias("acc"))
    return bins.agg((F.sum(F.abs(F.col("conf") - F.col("acc")) * F.col("n")) / F.sum("n")).alias("ece"))


def brier(rows: DataFrame) -> DataFrame:
    """Mean over rows of the squared error summed over classes."""
    per = F.aggregate(F.map_entries("p"), F.lit(0.0), lambda a, e: a + F.pow(e["value"] - (e["key"] == F.col("label")).cast("double"), F.lit(2.0)))
    return rows.agg(F.avg(per).alias("brier"))


def fit_temperature(predictions: DataFrame, grid: list[float] = TEMPERATURES) -> DataFrame:
    """(temperature, nll): the grid's value of least negative log likelihood, first on ties.

    One pass: a sum for each grid value, computed side by side.
    """
    nll = lambda t: F.sum(-F.log(F.greatest(F.coalesce(F.try_element_at(rescale(F.col("probabilities"), t), F.col("label")), F.lit(0.0)), F.lit(CLAMP))))
    sums = predictions.agg(*[nll(t).alias(f"t{k}") for k, t in enumerate(grid)])
    options = F.array(*[F.struct(F.round(F.col(f"t{k}"), 6).alias("nll"), F.lit(k).alias("k"), F.lit(t).alias("temperature")) for k, t in enumerate(grid)])
    return sums.select(F.array_min(options).alias("b")).select("b.temperature", "b.nll")


def threshold_table(rows: DataFrame) -> DataFrame:
    """(threshold, accepted, correct, wilson) for thresholds .50 to 1.00.

    Rows are counted once by the last threshold they pass; running sums over
    51 rows do the rest.
    """
    passed = F.floor(F.round(F.col("confidence") * 100, 9)).cast("int")
    counts = rows.filter(F.col("confidence") >= 0.5).groupBy(passed.alias("c")).agg(F.count("*").alias("n"), F.sum("hit").alias("h"))
    grid = rows.sparkSession.range(50, 101).select(F.col("id").cast("int").alias("c"))
    above = Window.orderBy(F.desc("c"))  # 51 rows
    full = grid.join(counts, "c", "left").withColumn("accepted", F.sum(F.coalesce("n", F.lit(0))).over(above)).withColumn("correct", F.sum(F.coalesce("h", F.lit(0))).over(above))
    return full.select((F.col("c") / 100).alias("threshold"), "accepted", "correct", F.round(wilson_lower(F.col("correct"), F.col("accepted")), 6).alias("wilson"))


def shared_prefix(a: Column, b: Column) -> Column:
    """Length of the common beginning of two arrays."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce((x == y).cast("int"), F.lit(0)))
    return F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(1).alias("go")), lambda s, x: F.struct((s["n"] + s["go"] * x).alias("n"), (s["go"] * x).alias("go")))["n"]


def nearest_ranks(rows: DataFrame, column: str, ranks: dict[str, float]) -> DataFrame:
    """One row of nearest-rank percentiles: the value number ceil(n * q) in order.

    Exact without gathering: distinct values are counted, range-sorted over
    tasks, and only their parts' counts are summed in one place.
    """
    spark = rows.sparkSession
    values = rows.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("__n"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = cut(values.repartitionByRange(parts, column).withColumn("__part", F.spark_partition_id()))
    sizes = ordered.groupBy("__part").agg(F.sum("__n").alias("__all"))  # one row per part
    before = sizes.select("__part", F.coalesce(F.sum("__all").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.sum("__all").over(Window.partitionBy()).alias("__total"))
    upto = F.sum("__n").over(Window.partitionBy("__part").orderBy(column)) + F.col("__before")
    placed = ordered.join(F.broadcast(before), "__part").withColumn("__upto", upto)
    at = lambda q: F.min(F.when(F.col("__upto") >= F.ceil(F.col("__total") * F.lit(q)), F.col(column)))
    return placed.agg(*[at(q).alias(name) for name, q in ranks.items()])
