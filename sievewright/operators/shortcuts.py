"""How well a single column already predicts the label."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from sievewright import fixed_values as fixed
from sievewright.functions import clean
from sievewright.functions.keys import col, text
from sievewright.operators.counts import BLANK
from sievewright.operators.running import running_sums


def _cells(df: DataFrame, features, label: str, scopes, pooled: bool) -> DataFrame:
    """Row counts per (scope, feature, value, label).

    One scan and one shuffle serve all features and scopes: rows are unpivoted,
    counted per finest scope, and the pool is summed from those counts.
    """
    listed = F.array(*[F.struct(F.lit(name).alias("feature"), text(c).alias("value"))
                       for name, c in features.items()])
    filled = F.col("value").isNotNull() & ~F.col("value").rlike(BLANK) & F.col("label").isNotNull()
    scope = text(scopes) if scopes else F.lit("all")
    counts = df.select(scope.alias("scope"), col(label).alias("label"), F.inline(listed)).where(filled) \
        .groupBy("scope", "feature", "value", "label").agg(F.count("*").alias("n"))
    if not (scopes and pooled):
        return counts
    both = counts.withColumn("scope", F.explode(F.array(F.col("scope"), F.lit("all"))))
    return both.groupBy("scope", "feature", "value", "label").agg(F.sum("n").alias("n"))


def shortcut_audit(df: DataFrame, features: dict, label: str = "label", scopes: str | None = None,
                   pooled: bool = True, strong: float = fixed.STRONG_ACCURACY) -> DataFrame:
    """Accuracy of a majority vote per value, Cramer's V, shared values and a verdict.

    Chi-square needs only occupied cells: chi2 = n * (sum o^2/(r*c) - 1), so
    margins of absent combinations are never formed.
    """
    value = Window.partitionBy("scope", "feature", "value")
    ordered = value.orderBy(F.desc("n"), "label")
    cells = _cells(df, features, label, scopes, pooled).withColumns({
        "r": F.sum("n").over(value), "rn": F.row_number().over(ordered),
        "real": F.max((F.col("label") == "real").cast("int")).over(value),
        "fake": F.max((F.col("label") == "fake").cast("int")).over(value)})
    lead = F.col("rn") == 1
    by_label = cells.groupBy("scope", "feature", "label").agg(
        F.sum("n").alias("c"), F.sum(F.col("n") * F.col("n") / F.col("r")).alias("s"),
        F.coalesce(F.sum(F.when(lead, F.col("n"))), F.lit(0)).alias("hits"), F.count_if(lead).alias("d"),
        F.count_if(lead & (F.col("real") + F.col("fake") == 2)).alias("shared"))
    rows = by_label.groupBy("scope", "feature").agg(
        F.sum("c").alias("n"), F.sum("d").alias("distinct_values"), F.sum("hits").alias("hits"),
        F.sum(F.col("s") / F.col("c")).alias("x"), F.count("*").alias("labels"),
        F.sum("shared").alias("shared_values"))
    k = F.least("distinct_values", "labels") - 1
    accuracy = F.col("hits") / F.col("n")
    v = F.when(k > 0, F.sqrt(F.greatest(F.col("x") - 1, F.lit(0.0)) / k)).otherwise(F.lit(0.0))
    return rows.select(
        "scope", "feature", "n", "distinct_values", F.round(accuracy, 4).alias("majority_accuracy"),
        F.round(v, 4).alias("cramers_v"), "shared_values",
        F.when(F.col("shared_values") == 0, "PERFECT SHORTCUT").when(accuracy >= strong, "STRONG")
        .otherwise("weak/none").alias("verdict"))


def majority_accuracy(df: DataFrame, feature: str, label: str = "label") -> DataFrame:
    """NULLs dropped, blanks kept."""
    counts = df.where(F.col(feature).isNotNull() & F.col(label).isNotNull()).groupBy(feature, label).agg(
        F.count("*").alias("n"))
    return counts.groupBy(feature).agg(F.max("n").alias("m"), F.sum("n").alias("n")).agg(
        F.sum("n").alias("n"), F.round(F.sum("m") / F.sum("n"), 6).alias("majority_accuracy"))


def cramers_v(df: DataFrame, feature: str, label: str = "label") -> DataFrame:
    counts = df.where(F.col(feature).isNotNull() & F.col(label).isNotNull()).groupBy(feature, label).agg(
        F.count("*").alias("o"))
    rows = counts.withColumn("r", F.sum("o").over(Window.partitionBy(feature)))
    first = F.row_number().over(Window.partitionBy(feature).orderBy(label)) == 1
    by_label = rows.withColumn("first", first).groupBy(label).agg(
        F.sum("o").alias("c"), F.sum(F.col("o") * F.col("o") / F.col("r")).alias("s"),
        F.count_if("first").alias("d"))
    total = by_label.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.sum(F.col("s") / F.col("c")).alias("x"),
                         F.least(F.sum("d"), F.count("*")).alias("k"))
    return total.select("n", F.round(F.when(
        (F.col("n") > 0) & (F.col("k") > 1),
        F.sqrt(F.greatest(F.col("x") - 1, F.lit(0.0)) / (F.col("k") - 1))).otherwise(F.lit(0.0)), 6).alias("cramers_v"))


def perfect_separator(df: DataFrame, features, by: str = "language_type", label: str = "label") -> DataFrame:
    """Values per label and shared by both; a feature is perfect when none is shared."""
    listed = F.array(*[F.struct(F.lit(f).alias("feature"), text(f).alias("value")) for f in features])
    values = df.select(F.col(by).alias("scope"), label, F.inline(listed)).where("value IS NOT NULL") \
        .groupBy("scope", "feature", "value").agg(
            F.bool_or(F.col(label) == "real").alias("real"), F.bool_or(F.col(label) == "fake").alias("fake"),
            F.count("*").alias("n"))
    both = F.col("real") & F.col("fake")
    return values.groupBy("scope", "feature").agg(
        F.count_if("real").alias("real_values"), F.count_if("fake").alias("fake_values"),
        F.count_if(both).alias("shared_values"),
        F.coalesce(F.sum(F.when(both, F.col("n"))), F.lit(0)).alias("ambiguous_rows")) \
        .withColumn("perfect", F.col("shared_values") == 0)


def _ladder(df: DataFrame, value, by, label: str, positive: str) -> DataFrame:
    """Distinct values with running positives and negatives, and the group totals."""
    by = list(by)
    named = df.where(F.col(label).isNotNull()).select(*by, label, clean.number(value).alias("v")).where("v IS NOT NULL")
    counts = named.groupBy(*by, "v").agg(
        F.count_if(F.col(label) == positive).alias("p"), F.count_if(F.col(label) != positive).alias("q"))
    return running_sums(counts, by, ["v"], {"p_upto": F.col("p"), "q_upto": F.col("q")}, keys_from=named,
                        totals={"p_all": "p_upto", "q_all": "q_upto"})


def _auc(p, q):
    below = F.col("q_upto") - F.col("q")
    wins = F.sum(F.col("p") * below + F.col("p") * F.col("q") * 0.5)
    return F.try_divide(wins, F.max(F.col("p_all").cast("double")) * F.max(F.col("q_all")))


def best_threshold(df: DataFrame, value, label: str = "label", by=(), positive: str = "fake") -> DataFrame:
    """Best accuracy of one cut `value <= t` or `value > t`, and the AUC from the same running sums."""
    ladder = _ladder(df, value, by, label, positive)
    total = F.col("p_all") + F.col("q_all")
    above = (F.col("q_upto") + F.col("p_all") - F.col("p_upto")) / total
    below = (F.col("p_upto") + F.col("q_all") - F.col("q_upto")) / total
    trivial = F.greatest("p_all", "q_all") / total
    return ladder.groupBy(*by).agg(
        F.max(total).alias("n"), F.round(F.max(F.greatest(above, below, trivial)), 6).alias("best_accuracy"),
        F.round(_auc("p", "q"), 6).alias("auc"))


def auc(df: DataFrame, value, label: str = "label", by=(), positive: str = "fake") -> DataFrame:
    """Chance that a positive row outranks a negative one, ties counted half."""
    return _ladder(df, value, by, label, positive).groupBy(*by).agg(
        F.max(F.col("p_all")).alias("positives"), F.max("q_all").alias("negatives"),
        F.round(_auc("p", "q"), 6).alias("auc"))


def rule_precision(df: DataFrame, predicate, label: str = "label", positive: str = "fake", by=()) -> DataFrame:
    """Precision, recall and accuracy of a one-line rule for the positive label."""
    hit = F.coalesce(predicate, F.lit(False))
    is_positive = F.col(label) == positive
    counts = df.where(F.col(label).isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(hit & is_positive).alias("tp"), F.count_if(hit & ~is_positive).alias("fp"),
        F.count_if(~hit & is_positive).alias("fn"), F.count_if(~hit & ~is_positive).alias("tn"))
    return counts.withColumns({
        "precision": F.round(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), 6),
        "recall": F.round(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), 6),
        "accuracy": F.round((F.col("tp") + F.col("tn")) / F.col("n"), 6)})
