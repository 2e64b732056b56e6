"""A classifier's evaluation in two steps: a policy fitted on calibration rows, its figures on test rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from fieldtrace.errors import FieldtraceError
from fieldtrace.operators import evaluate as V
from fieldtrace.runtime import beside, cut

LEAST_ACCEPTED = 100
LEAST_WILSON = 0.95


@dataclass(frozen=True)
class Policy:
    """Temperature and acceptance threshold (None: nothing is accepted), and the classes it may accept."""

    temperature: float
    threshold: float | None
    certified: tuple[str, ...]
    coverage: float


def check_rows(labels: DataFrame, predictions: DataFrame, leaves: list[str]) -> None:
    """Both sides must have the same ids, once each, and every prediction exactly the leaves as keys.

    Raises EVALUATION_INVALID with what is wrong. One full join and one scan.
    """
    p = predictions.select("id", (F.array_sort(F.map_keys("probabilities")) == F.array(*[F.lit(x) for x in sorted(leaves)])).alias("whole"), V.valid_probabilities(F.col("probabilities")).alias("valid"))
    counted = p.groupBy("id").agg(F.count("*").alias("n"), F.min("whole").alias("whole"), F.min("valid").alias("valid"))
    both = labels.groupBy("id").agg(F.count("*").alias("m")).join(counted, "id", "full")
    told = both.agg(
        F.count_if(F.col("n").isNull()).alias("unpredicted"), F.count_if(F.col("m").isNull()).alias("unlabelled"), F.count_if((F.col("n") > 1) | (F.col("m") > 1)).alias("repeated"),
        F.count_if(~F.col("whole")).alias("other classes"), F.count_if(~F.col("valid")).alias("no probabilities")).first().asDict()
    wrong = {k: v for k, v in told.items() if v}
    if wrong:
        raise FieldtraceError("EVALUATION_INVALID", ", ".join(f"{k}: {v}" for k, v in wrong.items()))


def accepted(rows: DataFrame, certified: tuple[str, ...]) -> DataFrame:
    """Judged rows whose chosen class may be accepted."""
    return rows.filter(F.col("chosen").isin(list(certified)))


def fit_policy(labels: DataFrame, predictions: DataFrame, leaves: list[str], certified: list[str], coverage: float) -> Policy:
    """The temperature of least loss and the first threshold that keeps its promise.

    ``labels``: (id, label) of the calibration rows; ``predictions``: (id,
    probabilities). A threshold keeps it with at least 100 accepted rows, a
    Wilson bound of 0.95 and the wanted coverage; if none does it is None.
    """
    check_rows(labels, predictions, leaves)
    rows = cut(labels.select("id", "label").join(predictions.select("id", "probabilities"), "id"))
    temperature = V.fit_temperature(rows).first()["temperature"]
    total = rows.count()
    steps = V.threshold_table(accepted(V.judged(rows, temperature), tuple(certified)))
    good = steps.filter((F.col("accepted") >= LEAST_ACCEPTED) & (F.col("wilson") >= LEAST_WILSON) & (F.col("accepted") >= coverage * total))
    return Policy(temperature, good.agg(F.min("threshold")).first()[0], tuple(certified), coverage)


def _paths(rows: DataFrame, paths: DataFrame) -> DataFrame:
    """Adds the root-to-leaf paths of label and chosen class; ``paths`` (leaf, path) is one row per class."""
    for c in ("label", "chosen"):
        rows = rows.join(paths.select(F.col("leaf").alias(c), F.col("path").alias(f"{c}_path")), c, "left")
    return rows


def evaluate(labels: DataFrame, predictions: DataFrame, paths: DataFrame, policy: Policy) -> DataFrame:
    """One row of figures of the test rows under a fitted policy.

    ``labels``: (id, label), ``predictions``: (id, probabilities, latency_ms),
    ``paths``: (leaf, path array<string>). All figures come from one pass over
    the judged rows and two small aggregates by class and by bin. Selective
    risk is null where nothing is accepted.
    """
    leaves = [r["leaf"] for r in paths.select("leaf").limit(100_001).collect()]  # classes; their probabilities are maps by class
    check_rows(labels, predictions, leaves)
    rows = V.judged(labels.select("id", "label").join(predictions.select("id", "probabilities", "latency_ms"), "id"), policy.temperature)
    rows = cut(_paths(rows, paths))
    shared = V.shared_prefix(F.col("chosen_path"), F.col("label_path"))
    took: Column = F.col("chosen").isin(list(policy.certified)) & (F.col("confidence") >= policy.threshold) if policy.threshold is not None else F.lit(False)
    told = rows.withColumn("shared", shared).withColumn("took", took.cast("int"))
    one = told.agg(
        F.count("*").alias("test_examples"), F.avg("hit").alias("leaf_accuracy"), F.avg(F.col("shared") / F.size("label_path")).alias("ancestor_path_accuracy"),
        F.avg(F.size("chosen_path") + F.size("label_path") - 2 * F.col("shared")).alias("tree_distance"), F.sum("took").alias("accepted"), F.sum(F.col("took") * F.col("hit")).alias("accepted_correct"),
        (F.count("*") * 1000 / F.greatest(F.sum("latency_ms"), F.lit(1e-9))).alias("sequential_throughput_per_second"))
    whole = beside(one, V.macro_f1(V.confusion(rows)), V.expected_calibration_error(rows), V.brier(rows), V.nearest_ranks(rows.select("latency_ms"), "latency_ms", {"p50_latency_ms": 0.5, "p95_latency_ms": 0.95}))
    n, a, c = F.col("test_examples"), F.col("accepted"), F.col("accepted_correct")
    return whole.withColumn("micro_f1", F.col("leaf_accuracy")).withColumn("wilson_lower_95", V.wilson_lower(c, a)).withColumn("coverage", a / n) \
        .withColumn("correct_auto_accept_coverage", c / n).withColumn("selective_risk", F.when(a > 0, 1 - c / a))
