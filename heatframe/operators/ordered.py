"""Order statistics without a key-wide sort: running totals, quantiles, ranks.

A window over a whole key puts a hot key into one task. Here the values of a key
are first counted (one row per distinct value, combined map-side), then cut into
bins by the leading bits of the value itself, on two levels. Totals are accumulated
over the coarse bins of a key and over the fine bins of a coarse one, so no window
sees more rows than there are such bins: values that share most of their leading bits, such as
times of one month or probabilities near 1, still fall into many fine bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Leading bits of a double that make up the bins of each level: sign, exponent and
# 12 and 28 bits of the fraction.
LEVEL_BITS = (24, 40)
BINS = [f"_bin{k}" for k in range(len(LEVEL_BITS))]


def order_bits(value: Column) -> Column:
    """A long that orders as the number does: the bits of the double, negative ones flipped.

    Never NULL: joins on the bins then add no condition of their own, so branches that
    read the same counts stay identical and share one shuffle.
    """
    number = value.cast("double") + F.lit(0.0)  # -0.0 becomes 0.0
    size = F.least(F.abs(number), F.lit(1.79e308))
    exponent = F.greatest(F.floor(F.log2(size)), F.lit(-1022)).cast("int")
    # log2 may be off by one next to a power of two; the fraction decides
    scaled = size / F.pow(F.lit(2.0), exponent)
    exponent = F.when(scaled >= 2, exponent + 1).when(scaled < 1, exponent - 1).otherwise(exponent)
    scaled = F.when(scaled >= 2, scaled / 2).when(scaled < 1, scaled * 2).otherwise(scaled)
    bits = (exponent.cast("long") + 1024) * F.lit(2**52) + F.floor((scaled - 1) * F.lit(2.0**52))
    found = F.when(size < 2.0**-1000, F.lit(0).cast("long")).when(number < 0, -bits).otherwise(bits)
    return F.coalesce(found, F.lit(0).cast("long"))


def with_bins(df: DataFrame, value: str) -> DataFrame:
    """Adds the bins of a number, non-decreasing in it on every level. They depend on the
    value alone, so they need no pass over the data and a re-run gives the same bins."""
    return df.withColumn("_bits", order_bits(F.col(value))).withColumns(
        {name: F.shiftright("_bits", 64 - n) for name, n in zip(BINS, LEVEL_BITS)}
    ).drop("_bits")


def running_totals(df: DataFrame, keys: list[str], order: list[str], sums: list[str], bins: list[str] | None = None) -> DataFrame:
    """Adds ``{s}_before`` (sum over earlier rows of the key) and ``{s}_total``.

    ``bins`` (the columns of ``with_bins`` unless given, coarse to fine) must not decrease
    along ``order``, and drop out of the result. Totals of the fine bins are added up to the
    coarser ones; windows run over the coarse bins of a key, the finer bins of a coarse one,
    and the rows of a fine one.
    """
    bins = BINS if bins is None else bins
    levels = [df.groupBy(*keys, *bins).agg(*[F.sum(s).alias(f"{s}_in") for s in sums])]
    for k in range(len(bins) - 1, 0, -1):
        levels.insert(0, levels[0].groupBy(*keys, *bins[:k]).agg(*[F.sum(f"{s}_in").alias(f"{s}_in") for s in sums]))
    placed = None
    for k, level in enumerate(levels):
        around = [*keys, *bins[:k]]
        along = Window.partitionBy(*around).orderBy(bins[k]).rowsBetween(Window.unboundedPreceding, 0)
        here = {f"{s}_offset": F.sum(f"{s}_in").over(along) - F.col(f"{s}_in") for s in sums}
        if placed is None:
            whole = Window.partitionBy(*keys)
            here |= {f"{s}_total": F.sum(f"{s}_in").over(whole) for s in sums}
            placed = level.withColumns(here).drop(*[f"{s}_in" for s in sums])
            continue
        coarser = placed.withColumnsRenamed({f"{s}_offset": f"{s}_base" for s in sums})
        placed = level.withColumns(here).join(coarser, around).withColumns(
            {f"{s}_offset": F.col(f"{s}_offset") + F.col(f"{s}_base") for s in sums}
        ).drop(*[f"{s}_in" for s in sums], *[f"{s}_base" for s in sums])
    inside = Window.partitionBy(*keys, *bins).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = df.select("*", *[(F.sum(s).over(inside) - F.col(s)).alias(f"{s}_local") for s in sums])
    joined = local.join(placed, [*keys, *bins])
    return joined.select(
        *[c for c in df.columns if c not in BINS],
        *[(F.col(f"{s}_offset") + F.col(f"{s}_local")).alias(f"{s}_before") for s in sums],
        *[f"{s}_total" for s in sums],
    )


def centred_rank(before: Column, n: Column, total: Column) -> Column:
    """Average rank of tied values less the mean rank: a multiple of one half, so it is exactly 0 where
    all values are equal."""
    return (before + (n - total) / 2.0).cast("double")


def value_counts(df: DataFrame, keys: list[str], value: str, n: str = "n") -> DataFrame:
    """(keys, value, n) of the non-missing values, with their bins."""
    return with_bins(df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias(n)), value)


def average_ranks(df: DataFrame, keys: list[str], value: str, weight: str | None = None) -> DataFrame:
    """(keys, value, n, rank, centred): tied values share the mean of their positions;
    ``centred`` is the rank less the mean rank.

    ``weight`` names a count column when ``df`` is already aggregated.
    """
    if weight is None:
        counts = value_counts(df, keys, value)
    else:
        counts = with_bins(df.groupBy(*keys, value).agg(F.sum(weight).alias("n")), value)
    placed = running_totals(counts, keys, [value], ["n"])
    rank = F.col("n_before") + (F.col("n") + 1) / 2.0
    return placed.select(
        *keys, value, "n", rank.alias("rank"), centred_rank(F.col("n_before"), F.col("n"), F.col("n_total")).alias("centred")
    )


def quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], approx: bool = False) -> DataFrame:
    """One row per key: exact quantiles (linear interpolation), missing values skipped.

    Bin totals locate the bins that hold the wanted positions; only the distinct
    values of those bins are ordered. ``approx`` uses the built-in sketch instead.
    """
    if approx:
        present = df.where(F.col(value).isNotNull())
        return present.groupBy(*keys).agg(
            *[F.percentile_approx(value, p, 10000).alias(name) for name, p in probs.items()]
        )
    counts = value_counts(df, keys, value, "_n")

    def position(p: float) -> Column:
        return F.lit(p) * (F.col("_total") - 1)

    def holds(index: Column, start: Column, stop: Column) -> Column:
        return (start <= index) & (index < stop)

    def wanted(start: Column, stop: Column) -> Column:
        found = F.lit(False)
        for p in probs.values():
            for edge in (F.floor(position(p)), F.ceil(position(p))):
                found = found | holds(edge, start, stop)
        return found

    # from the coarse bins to the fine ones, only the bins that hold a wanted position go on
    levels = [counts.groupBy(*keys, *BINS).agg(F.sum("_n").alias("_in"))]
    for k in range(len(BINS) - 1, 0, -1):
        levels.insert(0, levels[0].groupBy(*keys, *BINS[:k]).agg(F.sum("_in").alias("_in")))
    kept = None
    for k, level in enumerate(levels):
        if kept is None:
            level = level.withColumns({"_total": F.sum("_in").over(Window.partitionBy(*keys)), "_base": F.lit(0).cast("long")})
        else:
            level = level.join(kept.select(*keys, *BINS[:k], "_total", F.col("_offset").alias("_base")), [*keys, *BINS[:k]])
        along = Window.partitionBy(*keys, *BINS[:k]).orderBy(BINS[k]).rowsBetween(Window.unboundedPreceding, 0)
        level = level.withColumn("_upto", F.col("_base") + F.sum("_in").over(along)).withColumn("_offset", F.col("_upto") - F.col("_in"))
        kept = level.where(wanted(F.col("_offset"), F.col("_upto"))).select(*keys, *BINS[:k + 1], "_total", "_offset")
    inside = Window.partitionBy(*keys, *BINS).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        counts.join(kept, [*keys, *BINS])
        .withColumn("_stop", F.col("_offset") + F.sum("_n").over(inside))
        .withColumn("_start", F.col("_stop") - F.col("_n"))
    )
    aggs = [F.max("_total").alias("_total")]
    for i, p in enumerate(probs.values()):
        for side, edge in (("lo", F.floor(position(p))), ("hi", F.ceil(position(p)))):
            picked = F.when(holds(edge, F.col("_start"), F.col("_stop")), F.col(value).cast("double"))
            aggs.append(F.max(picked).alias(f"_q{i}_{side}"))
    found = placed.groupBy(*keys).agg(*aggs)
    return found.select(
        *keys,
        *[
            (
                F.col(f"_q{i}_lo")
                + (F.col(f"_q{i}_hi") - F.col(f"_q{i}_lo")) * (position(p) - F.floor(position(p)))
            ).alias(name)
            for i, (name, p) in enumerate(probs.items())
        ],
    )
