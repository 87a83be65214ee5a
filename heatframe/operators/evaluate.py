"""Evaluation of alarms and scores, exact and without sorting all rows in one place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heatframe.functions.scalar import ratio, ratio_or_zero
from heatframe.operators.ordered import running_totals, with_bins
from heatframe.operators.climate import long_form

# Wording of an attribution's effect.
RAISES = "↑ heat event"
LOWERS = "↓ no event"


def error_class(truth: Column, pred: Column, prob: Column | None = None, confident: float = 0.8) -> Column:
    """TP, FN, FP, TN; with a probability also ``confident_FP``. NULL without truth or prediction."""
    base = (
        F.when((truth == 1) & (pred == 1), "TP").when((truth == 1) & (pred == 0), "FN")
        .when((truth == 0) & (pred == 1), "FP").when((truth == 0) & (pred == 0), "TN")
    )
    return base if prob is None else F.when((truth == 0) & (prob > confident), "confident_FP").otherwise(base)


def class_balance(df: DataFrame, keys: list[str], truth: str) -> DataFrame:
    """(keys, n, positives, share, neg_pos_ratio)."""
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col(truth).cast("long")).alias("positives"))
    return out.withColumns(
        {
            "share": ratio(F.col("positives"), F.col("n")),
            "neg_pos_ratio": ratio(F.col("n") - F.col("positives"), F.col("positives")),
        }
    )


def cell_counts(df: DataFrame, keys: list[str], truth: str, pred: str) -> DataFrame:
    """(keys, tp, fp, tn, fn), one row per key, over the rows that have both sides; a key
    without such a row has zeros."""
    t, p = F.col(truth) == 1, F.col(pred) == 1
    cells = {"tp": t & p, "fp": ~t & p, "tn": ~t & ~p, "fn": t & ~p}
    return df.groupBy(*keys).agg(*[F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(n) for n, c in cells.items()])


def confusion_matrix(df: DataFrame, keys: list[str], truth: str, pred: str) -> DataFrame:
    """(keys, truth, pred, n, row_share) for all four cells, empty ones with 0."""
    cells = F.array(
        *[
            F.struct(F.lit(a).alias("truth"), F.lit(b).alias("pred"), F.col(c).alias("n"), (F.col(c) + F.col(o)).alias("_row"))
            for a, b, c, o in ((0, 0, "tn", "fp"), (0, 1, "fp", "tn"), (1, 0, "fn", "tp"), (1, 1, "tp", "fn"))
        ]
    )
    tall = cell_counts(df, keys, truth, pred).select(*keys, F.inline(cells))
    return tall.withColumn("row_share", ratio_or_zero(F.col("n"), F.col("_row"))).drop("_row")


def classification_report(df: DataFrame, keys: list[str], truth: str, pred: str) -> DataFrame:
    """(keys, label, precision, recall, f1, support): class 0, class 1, accuracy, macro
    and weighted averages; a zero denominator counts as 0."""
    c = cell_counts(df, keys, truth, pred)
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))

    def scores(hit: Column, false: Column, missed: Column) -> dict[str, Column]:
        return {
            "precision": ratio_or_zero(hit, hit + false),
            "recall": ratio_or_zero(hit, hit + missed),
            "f1": ratio_or_zero(2 * hit, 2 * hit + false + missed),
        }

    zero, one = scores(tn, fn, fp), scores(tp, fp, fn)
    n0, n1 = tn + fp, tp + fn
    n = n0 + n1
    accuracy = ratio_or_zero(tp + tn, n)
    lines = [("0", zero, n0), ("1", one, n1), ("accuracy", dict.fromkeys(zero, accuracy), n)]
    lines.append(("macro avg", {m: (zero[m] + one[m]) / 2 for m in zero}, n))
    lines.append(("weighted avg", {m: ratio_or_zero(zero[m] * n0 + one[m] * n1, n) for m in zero}, n))
    rows = [
        F.struct(F.lit(name).alias("label"), *[v.alias(m) for m, v in values.items()], size.alias("support"))
        for name, values, size in lines
    ]
    return c.select(*keys, F.inline(F.array(*rows)))


def score_counts(df: DataFrame, keys: list[str], truth: str, score: str) -> DataFrame:
    """Positives, negatives and both sums below each distinct score of a key, over the rows
    that have a truth and a score."""
    t = F.col(truth).cast("long")
    counts = df.where(F.col(truth).isNotNull() & F.col(score).isNotNull()).groupBy(*keys, F.col(score).cast("double").alias("score")).agg(
        F.sum(t).alias("pos"), F.sum(1 - t).alias("neg")
    )
    return running_totals(with_bins(counts, "score"), keys, ["score"], ["pos", "neg"])


def roc_auc(df: DataFrame, keys: list[str], truth: str, score: str) -> DataFrame:
    """(keys, roc_auc): share of positive/negative pairs in the right order, ties half."""
    placed = score_counts(df, keys, truth, score)
    won = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0)).cast("double")
    pairs = (F.max("pos_total") * F.max("neg_total")).cast("double")
    return placed.groupBy(*keys).agg(F.try_divide(won, pairs).alias("roc_auc"))


def average_precision(df: DataFrame, keys: list[str], truth: str, score: str) -> DataFrame:
    """(keys, average_precision): sum of recall steps times precision at the step."""
    placed = score_counts(df, keys, truth, score)
    hits = F.col("pos_total") - F.col("pos_before")
    alarms = hits + F.col("neg_total") - F.col("neg_before")
    step = ratio(F.col("pos"), F.col("pos_total")) * ratio(hits, alarms)
    return placed.groupBy(*keys).agg(F.sum(step).alias("average_precision"))


def skill_ratio(df: DataFrame, keys: list[str], truth: str, score: str, baseline: str) -> DataFrame:
    """(keys, model_ap, baseline_ap, skill)."""
    model = average_precision(df, keys, truth, score).withColumnRenamed("average_precision", "model_ap")
    base = average_precision(df, keys, truth, baseline).withColumnRenamed("average_precision", "baseline_ap")
    return model.join(base, keys).withColumn("skill", ratio(F.col("model_ap"), F.col("baseline_ap")))


def regression_metrics(df: DataFrame, keys: list[str], truth: str, pred: str) -> DataFrame:
    """(keys, n, mae, r2) over the rows that have both sides."""
    error = F.col(truth) - F.col(pred)
    sums = df.where(F.col(truth).isNotNull() & F.col(pred).isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(F.abs(error)).alias("mae"), F.sum(error * error).alias("_res"),
        (F.var_pop(truth) * F.count(truth)).alias("_tot"),
    )
    return sums.select(*keys, "n", "mae", (1 - F.try_divide(F.col("_res"), F.col("_tot"))).alias("r2"))


def report_by_entity(df: DataFrame, key: str, truth: str, pred: str, digits: int = 2) -> DataFrame:
    """(key, precision, recall, f1, support) of class 1, rounded."""
    report = classification_report(df, [key], truth, pred).where(F.col("label") == "1")
    return report.select(key, *[F.round(m, digits).alias(m) for m in ("precision", "recall", "f1")], "support")


def confident_false_alarms(df: DataFrame, key: str, truth: str, prob: str, value: str, cut: float = 0.8) -> DataFrame:
    """(key, n, share_pct, mean_value): where the sure but wrong alarms are, a row with
    key ``total`` for all of them."""
    wrong = df.where((F.col(truth) == 0) & (F.col(prob) > cut))
    sums = wrong.groupBy(F.col(key).cast("string").alias(key)).agg(
        F.count("*").alias("n"), F.sum(value).alias("_sum"), F.count(value).alias("_with")
    )
    whole = sums.agg(*[F.sum(c).alias(c) for c in ("n", "_sum", "_with")])
    all_n = whole.first()["n"]  # one number
    total = whole.where("n IS NOT NULL").select(F.lit("total").alias(key), "n", "_sum", "_with")
    return sums.unionByName(total).select(
        key, "n", ratio(F.col("n") * 100, F.lit(all_n).cast("long")).alias("share_pct"),
        F.try_divide(F.col("_sum").cast("double"), F.col("_with").cast("double")).alias("mean_value"),
    )


def class_means(df: DataFrame, features: list[str], classes: Column, a: str, b: str) -> DataFrame:
    """(feature, mean_a, mean_b, difference, rank): feature means of two row classes,
    largest absolute difference first. One aggregate, one row per feature to rank."""
    marked = df.select(classes.alias("_class"), *features)
    sums = marked.agg(
        *[F.avg(F.when(F.col("_class") == k, F.col(f))).alias(f"{f}|{s}") for f in features for s, k in (("a", a), ("b", b))]
    )
    rows = F.array(
        *[F.struct(F.lit(f).alias("feature"), F.col(f"{f}|a").alias("mean_a"), F.col(f"{f}|b").alias("mean_b")) for f in features]
    )
    out = sums.select(F.inline(rows)).withColumn("difference", F.col("mean_a") - F.col("mean_b"))
    order = Window.orderBy(F.abs("difference").desc_nulls_last(), "feature")
    return out.withColumn("rank", F.row_number().over(order))


def stability(df: DataFrame, classes: Column, spread: str, change: str) -> DataFrame:
    """(error_class, n, std, mean_abs_change)."""
    return df.groupBy(classes.alias("error_class")).agg(
        F.count("*").alias("n"), F.stddev_samp(spread).alias("spread_std"), F.avg(F.abs(change)).alias("mean_abs_change")
    )


def sign_change(tall: DataFrame, keys: list[str], value: str, score: str) -> DataFrame:
    """(keys, threshold): in order of ``value``, the value just before ``score`` first
    changes sign; NULL when it never does. Equal values are ordered by score.

    Equal values collapse to their smallest and largest sign first. Neighbours are
    compared inside value bins; across bins only each bin's ends are.
    """
    signs = (
        tall.where(F.col(value).isNotNull() & F.col(score).isNotNull())
        .groupBy(*keys, value)
        .agg(F.min(F.signum(score)).alias("low"), F.max(F.signum(score)).alias("high"))
    )
    signs = with_bins(signs, value).withColumn("_bin", F.col("_bin1"))
    inside = Window.partitionBy(*keys, "_bin").orderBy(value)
    following = F.lead("low").over(inside)
    local = signs.withColumn("_turns", (F.col("low") != F.col("high")) | F.coalesce(following != F.col("high"), F.lit(False)))
    bins = local.groupBy(*keys, "_bin").agg(
        F.min(F.when(F.col("_turns"), F.col(value))).alias("_at"),
        F.min_by("low", value).alias("_first"),
        F.max_by("high", value).alias("_last"),
        F.max(value).alias("_end"),
    )
    across = F.lead("_first").over(Window.partitionBy(*keys).orderBy("_bin"))
    ends = bins.withColumn("_edge", F.when(across != F.col("_last"), F.col("_end")))
    return ends.groupBy(*keys).agg(F.min(F.least("_at", "_edge")).alias("threshold"))


def contribution_pct(importance: DataFrame, value: str = "importance") -> DataFrame:
    """Adds each feature's percentage of the total (one row per feature)."""
    return importance.withColumn(
        "contribution_pct", ratio(F.col(value) * 100, F.sum(value).over(Window.partitionBy()))
    )


def top_features(importance: DataFrame, n: int = 20, value: str = "importance") -> DataFrame:
    order = Window.orderBy(F.col(value).desc(), "feature")
    return importance.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def attribution_importance(tall: DataFrame, score: str = "score") -> DataFrame:
    """(feature, importance, direction): mean absolute and mean attribution."""
    return tall.groupBy("feature").agg(F.avg(F.abs(score)).alias("importance"), F.avg(score).alias("direction"))


def attribution_table(tall: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` strongest features of a long (feature, value, score) table: importance,
    direction, effect, sign-change threshold, mean and standard deviation."""
    top = top_features(attribution_importance(tall), n)
    moments = tall.groupBy("feature").agg(F.avg("value").alias("feature_mean"), F.stddev_samp("value").alias("feature_std"))
    table = top.join(sign_change(tall, ["feature"], "value", "score"), "feature", "left").join(moments, "feature")
    return table.withColumn("effect", F.when(F.col("direction") > 0, RAISES).otherwise(LOWERS))


def attribution_rows(df: DataFrame, ids: list[str], features: list[str]) -> DataFrame:
    """Long (ids, feature, value) form of wide features."""
    return long_form(df, ids, features).withColumnRenamed("variable", "feature")
