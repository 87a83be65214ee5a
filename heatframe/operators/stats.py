"""Rank correlation, lag profiles, normal plots and variable groups."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from heatframe.functions.statistics import corr_from_centred, normal_quantile, safe_corr, student_t_two_sided
from heatframe.operators.climate import long_form
from heatframe.operators.ordered import average_ranks, centred_rank, running_totals, with_bins
from heatframe.operators.series import GAP, Series, over_rows

LAGS_SIDE_BY_SIDE = 12
PAIR_SUMS = {"feature": IntegerType(), "lag": IntegerType(), "_xy": DoubleType(), "_xx": DoubleType(), "_yy": DoubleType()}


def spearman_by(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, n, rho): Spearman correlation over the complete pairs of each key.

    Pairs are counted before anything is shuffled, ranks come from the counts, and the
    sums are weighted, so repeated values cost nothing. Ranks are centred, so a constant
    side sums to exactly 0 and gives NULL.
    """
    pairs = df.select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    joint = pairs.where("_x IS NOT NULL AND _y IS NOT NULL").groupBy(*keys, "_x", "_y").agg(F.count("*").alias("_c"))
    rank_x = average_ranks(joint, keys, "_x", weight="_c").select(*keys, "_x", F.col("centred").alias("_rx"))
    rank_y = average_ranks(joint, keys, "_y", weight="_c").select(*keys, "_y", F.col("centred").alias("_ry"))
    rows = joint.join(rank_x, [*keys, "_x"]).join(rank_y, [*keys, "_y"])
    c, rx, ry = F.col("_c"), F.col("_rx"), F.col("_ry")
    sums = rows.groupBy(*keys).agg(
        F.sum(c).alias("n"), F.sum(c * rx * rx).alias("_xx"), F.sum(c * ry * ry).alias("_yy"),
        F.sum(c * rx * ry).alias("_xy"),
    )
    return sums.select(*keys, "n", corr_from_centred(F.col("_xy"), F.col("_xx"), F.col("_yy")).alias("rho"))


def trend_test(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, n, rho, t, p_value): Spearman trend with its two-sided t test."""
    out = spearman_by(df, keys, x, y)
    t = F.col("rho") * F.sqrt(F.try_divide((F.col("n") - 2).cast("double"), 1 - F.col("rho") * F.col("rho")))
    out = out.withColumn("t", t)
    exact = F.when(F.abs("rho") >= 1.0, F.lit(0.0))
    return out.withColumn("p_value", exact.when(F.col("n") > 2, student_t_two_sided(F.col("t"), F.col("n") - 2)))


def spread_rows(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows spread evenly by a hash of ``by``; how many partitions is left to Spark."""
    return df.repartition(*by)


def pair_correlations(
    df: DataFrame, keys: list[str], ids: list[str], pairs: list[tuple[str, str]]
) -> DataFrame:
    """(keys, var_a, var_b, rho) of the listed pairs of columns, each over its own complete rows.

    A value's rank depends on which rows of the other variable are present, so every
    distinct value of a variable is counted once for each partner, side by side in one
    row. One running total over (key, variable) then gives all ranks, and one grouping by
    ``ids``, which tell the rows of a key apart, brings them back to the rows: the number
    of shuffles does not grow with the number of columns.
    """
    columns = list(dict.fromkeys(v for pair in pairs for v in pair))
    size = len(columns)
    rows = spread_rows(df.select(*keys, *ids, *[F.col(c).cast("double").alias(c) for c in columns]), [*keys, *ids])
    there = F.array(*[F.col(c).isNotNull().cast("long") for c in columns])
    cells = F.array(*[F.struct(F.lit(i).alias("_var"), F.col(c).alias("_value")) for i, c in enumerate(columns)])
    tall = rows.select(*keys, *ids, there.alias("_there"), F.inline(cells)).where("_value IS NOT NULL")
    counted = tall.groupBy(*keys, "_var", "_value").agg(
        *[F.sum(F.col("_there")[j]).alias(f"_n{j}") for j in range(size)]
    )
    sums = [f"_n{j}" for j in range(size)]
    placed = running_totals(with_bins(counted, "_value"), [*keys, "_var"], ["_value"], sums)
    centred = [centred_rank(F.col(f"{n}_before"), F.col(n), F.col(f"{n}_total")) for n in sums]
    ranks = placed.select(*keys, "_var", "_value", F.array(*centred).alias("_ranks"))
    back = tall.join(ranks, [*keys, "_var", "_value"]).groupBy(*keys, *ids).agg(
        *[F.max(F.when(F.col("_var") == i, F.col("_ranks"))).alias(f"_r{i}") for i in range(size)]
    )
    at = {c: i for i, c in enumerate(columns)}

    def ranks_of(a: str, b: str) -> Column:
        """Ranks of ``a`` among the rows that have ``b``, on those rows."""
        return F.when(F.col(f"_r{at[b]}").isNotNull(), F.col(f"_r{at[a]}")[at[b]])

    products = []
    for n, (a, b) in enumerate(pairs):
        x, y = ranks_of(a, b), ranks_of(b, a)
        products += [F.sum(x * y).alias(f"_xy{n}"), F.sum(x * x).alias(f"_xx{n}"), F.sum(y * y).alias(f"_yy{n}")]
    found = back.groupBy(*keys).agg(*products)
    out = [
        F.struct(
            F.lit(a).alias("var_a"), F.lit(b).alias("var_b"),
            corr_from_centred(F.col(f"_xy{n}"), F.col(f"_xx{n}"), F.col(f"_yy{n}")).alias("rho"),
        )
        for n, (a, b) in enumerate(pairs)
    ]
    return found.select(*keys, F.inline(F.array(*out)))


def spearman_matrix(df: DataFrame, keys: list[str], ids: list[str], columns: list[str]) -> DataFrame:
    """(keys, var_a, var_b, rho) for var_a <= var_b in the order of ``columns``, pair by
    pair over the rows that have both; ``ids`` tell the rows of a key apart."""
    return pair_correlations(df, keys, ids, [(a, b) for i, a in enumerate(columns) for b in columns[i:]])


def spearman_pooled(df: DataFrame, ids: list[str], columns: list[str]) -> DataFrame:
    """The matrix over all entities together."""
    return spearman_matrix(df.withColumn("_pool", F.lit("all")), ["_pool"], ids, columns).drop("_pool")


def full_matrix(upper: DataFrame, keys: list[str]) -> DataFrame:
    """Both triangles and the diagonal."""
    mirrored = F.array(
        F.struct(F.col("var_a").alias("a"), F.col("var_b").alias("b")),
        F.struct(F.col("var_b").alias("a"), F.col("var_a").alias("b")),
    )
    cells = F.when(F.col("var_a") == F.col("var_b"), F.slice(mirrored, 1, 1)).otherwise(mirrored)
    return upper.select(*keys, F.inline(cells), "rho").withColumnsRenamed({"a": "var_a", "b": "var_b"})


def strength_rank(upper: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, variable, mean_abs_rho, rank): mean |rho| over all variables, itself
    included; undefined correlations are skipped. Ranks one row per variable."""
    strength = full_matrix(upper, keys).groupBy(*keys, F.col("var_a").alias("variable")).agg(
        F.avg(F.abs("rho")).alias("mean_abs_rho")
    )
    order = Window.partitionBy(*keys).orderBy(F.col("mean_abs_rho").desc_nulls_last(), "variable")
    return strength.withColumn("rank", F.row_number().over(order))


def collinear_groups(upper: DataFrame, keys: list[str], columns: list[str], cut: float) -> DataFrame:
    """(keys, variable, group): connected variables with |rho| >= ``cut``; a group is
    named by its alphabetically first member.

    The links are a table of one row per strong pair. Paths double in length in a round, so
    the logarithm of the number of columns is enough.
    """
    strong = F.coalesce(F.abs("rho") >= cut, F.lit(False)) | (F.col("var_a") == F.col("var_b"))
    reach = full_matrix(upper, keys).where(strong).select(*keys, "var_a", "var_b")
    rounds = max(1, (len(columns) - 1).bit_length())
    for _ in range(rounds):
        onward = reach.select(*keys, F.col("var_a").alias("var_b"), F.col("var_b").alias("_to"))
        reach = reach.join(onward, [*keys, "var_b"]).select(*keys, "var_a", F.col("_to").alias("var_b")).distinct()
    return reach.groupBy(*keys, F.col("var_a").alias("variable")).agg(F.min("var_b").alias("group"))


def countdown_corr(
    df: DataFrame, series: Series, value: str, features: list[str], lags: list[int], season: Column | None = None
) -> DataFrame:
    """(keys, feature, lag, rho): today's values against the change of ``value`` in
    ``lag`` rows. The change is taken before the season is cut."""
    jumps = {f"_jump_{k}": k for k in lags}
    moved = over_rows(
        df, series, 0, max(lags), lambda w: {n: F.lead(value, k).over(w) - F.col(value) for n, k in jumps.items()}
    )
    kept = moved if season is None else moved.where(season)
    keys = series.key_list
    table = pair_correlations(kept, keys, [series.ts], [(f, j) for f in features for j in jumps])
    lag = F.regexp_extract("var_b", r"(\d+)$", 1).cast("int")
    return table.select(*keys, F.col("var_a").alias("feature"), lag.alias("lag"), "rho")


def lag_profile(
    df: DataFrame, series: Series, value: str, features: list[str], max_lag: int = 72, season: Column | None = None
) -> DataFrame:
    """(keys, feature, lag, rho) for every lag 1..max_lag: each feature against the
    change of ``value`` over the next ``lag`` rows, over the complete pairs of each.

    An entity's rows travel once for each group of lags, not once for each lag and feature: a group holds one entity's
    value and features, 8 bytes each a row (63 MB for a century of hours and 8 features), and gives sums of centred
    ranks. Rows without a key count for no entity.
    """
    keys, names = series.key_list, [f"_f{i}" for i in range(len(features))]
    columns = [F.col(c).cast("double").alias(n) for c, n in zip([value, *features], ["_v", *names])]
    rows = df.select(
        *keys, (series.tick() if series.dense else F.col(series.ts)).alias("_at"), *columns,
        F.coalesce(F.lit(True) if season is None else season, F.lit(False)).alias("_in"),
    ).dropna("any", subset=[*keys, *(["_at"] if series.dense else [])] or ["_in"])
    groups = F.sequence(F.lit(0), F.lit((max_lag - 1) // LAGS_SIDE_BY_SIDE))
    fields = [f for f in rows.schema.fields if f.name in keys]
    schema = StructType([*fields, *[StructField(n, t) for n, t in PAIR_SUMS.items()]])
    dense = series.dense

    def sums(group: pa.Table) -> pa.Table:
        first = group.column("_g")[0].as_py() * LAGS_SIDE_BY_SIDE + 1
        found = lag_sums(group, names, range(first, min(first + LAGS_SIDE_BY_SIDE, max_lag + 1)), dense)
        own = group.select(keys).take(pa.array(np.zeros(len(found["lag"]), "i8")))
        return pa.table([*own.columns, *map(pa.array, found.values())], names=[*keys, *found])

    table = rows.select("*", F.explode(groups).alias("_g")).groupBy(*keys, "_g").applyInArrow(sums, schema)
    name = F.get(F.array(*[F.lit(f) for f in features]), F.col("feature"))
    return table.select(*keys, name.alias("feature"), "lag", corr_from_centred(F.col("_xy"), F.col("_xx"), F.col("_yy")).alias("rho"))


def lag_sums(rows: pa.Table, features: list[str], lags: range, dense: bool) -> dict[str, np.ndarray]:
    """PAIR_SUMS of one entity's rows, where a feature meets a change at all. Ranks are centred, so sums of a constant
    side are exactly 0."""
    rows = rows.take(pc.sort_indices(rows, [("_at", "ascending")], null_placement="at_start"))
    if dense and (np.diff(rows.column("_at").to_numpy()) != 1).any():
        raise ValueError(GAP)
    value, kept = rows.column("_v").to_numpy(), rows.column("_in").to_numpy()
    known = rows.column("_v").is_valid().to_numpy()
    sides = []  # of a feature: its rows in order of value, the first row of each value and the place of every row's value
    there = np.column_stack([rows.column(f).is_valid().to_numpy() for f in features])
    for k, f in enumerate(features):
        at = np.flatnonzero(there[:, k])
        of = rows.column(f).to_numpy()[at]
        order = np.argsort(of, kind="stable")
        sides.append((at[order], *tied(of[order])))
    out = []
    for lag in lags:
        pairs = np.zeros(len(value), bool)
        pairs[:-lag] = known[:-lag] & known[lag:] & kept[:-lag]
        at = np.flatnonzero(pairs)
        if not len(at):
            continue
        change = value[at + lag] - value[at]
        order = np.argsort(change, kind="stable")
        at, (starts, place) = at[order], tied(change[order])
        for k, (own, own_starts, own_place) in enumerate(sides):
            n = int(there[at, k].sum())
            if n:
                x, y = np.zeros(len(value)), np.zeros(len(value))
                x[own] = centred_ranks(pairs[own], own_starts, own_place)
                y[at] = centred_ranks(there[at, k], starts, place)
                both = pairs & there[:, k]
                x, y = x[both], y[both]
                out.append((k, lag, x @ y, x @ x, y @ y))
    return {n: np.array(c, t) for n, c, t in zip(PAIR_SUMS, zip(*out) if out else [()] * len(PAIR_SUMS), ("i4", "i4", "f8", "f8", "f8"))}


def tied(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted values: the first place of each distinct one, and which one every place holds. NaN equals NaN."""
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) & ~(np.isnan(values[1:]) & np.isnan(values[:-1]))
    return np.flatnonzero(new), np.cumsum(new) - 1


def centred_ranks(counted: np.ndarray, starts: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Average rank, among those counted, of every place of a sorted column, less the mean rank."""
    n = np.add.reduceat(counted, starts, dtype="i8") if len(starts) else np.empty(0, "i8")
    return (np.cumsum(n) - n + (n - n.sum()) / 2.0)[place]


def lag_checkpoints(profile: DataFrame, keys: list[str], points: list[int]) -> DataFrame:
    """One row per (keys, feature) with ``lag_{p}`` columns and the rank by |rho| at the
    first checkpoint."""
    table = profile.where(F.col("lag").isin(points)).groupBy(*keys, "feature").agg(
        *[F.max(F.when(F.col("lag") == p, F.col("rho"))).alias(f"lag_{p}") for p in points]
    )
    order = Window.partitionBy(*keys).orderBy(F.abs(f"lag_{points[0]}").desc_nulls_last(), "feature")
    return table.withColumn("rank", F.row_number().over(order))


def ordinal_positions(df: DataFrame, series: Series, columns: list[str]) -> DataFrame:
    """(keys, variable, value, ordinal, n): every value with its place in sorted order.

    Equal values are numbered per calendar chunk, so one frequent value (a zero at
    night) is spread over many groups.
    """
    tall = long_form(df.withColumn("_chunk", series.chunk()).withColumn("_tick", series.tick()),
                     [*series.keys, "_chunk", "_tick"], columns)
    by = [*series.keys, "variable"]
    pieces = tall.groupBy(*by, "value", "_chunk").agg(F.count("*").alias("n"))
    placed = running_totals(with_bins(pieces, "value"), by, ["value", "_chunk"], ["n"])
    same = Window.partitionBy(*by, "value", "_chunk").orderBy("_tick")
    return (
        tall.withColumn("_place", F.row_number().over(same))
        .join(placed.select(*by, "value", "_chunk", "n_before", "n_total"), [*by, "value", "_chunk"])
        .select(*by, "value", (F.col("n_before") + F.col("_place")).alias("ordinal"), F.col("n_total").alias("n"))
    )


def plotting_position(ordinal: Column, n: Column) -> Column:
    """Filliben's estimate of the uniform order statistic medians."""
    ends = F.pow(F.lit(0.5), 1.0 / n)
    middle = (ordinal - 0.3175) / (n + 0.365)
    return F.when(ordinal == n, ends).when(ordinal == 1, 1 - ends).otherwise(middle)


def qq_normal(df: DataFrame, series: Series, columns: list[str]) -> DataFrame:
    """Points of a normal probability plot per (keys, variable)."""
    placed = ordinal_positions(df, series, columns)
    probability = plotting_position(F.col("ordinal"), F.col("n"))
    return placed.withColumn("theoretical", normal_quantile(probability))


def qq_fit(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, slope, intercept, r) of the line through a probability plot."""
    x, y = F.col("theoretical"), F.col("value")
    fit = points.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(x).alias("_mx"), F.avg(y).alias("_my"),
        F.covar_pop(x, y).alias("_cov"), F.var_pop(x).alias("_var"), safe_corr(x, y).alias("r"),
    )
    slope = F.try_divide(F.col("_cov"), F.col("_var"))
    return fit.select(*keys, "n", slope.alias("slope"), (F.col("_my") - slope * F.col("_mx")).alias("intercept"), "r")
