"""Building blocks that stay whole and exact when one key holds a third of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def ordinal_in_group(df: DataFrame, keys: list[str], order: list[str], name: str, lead: int = 1) -> DataFrame:
    """Zero-based position (bigint) of each row inside its group; one plan at every size.

    The first ``lead`` order columns cut a group into blocks. Rows are numbered inside their block and shifted by the
    number of rows in the group's earlier blocks, which comes from counts combined before the shuffle. So a group with a
    third of all rows is spread over as many tasks as it has blocks; ``lead`` should reach columns that vary inside a group.
    """
    block = [*keys, *order[:lead]]
    before = Window.partitionBy(*keys).orderBy(*order[:lead]).rowsBetween(Window.unboundedPreceding, -1)
    shift = df.groupBy(*block).agg(F.count(F.lit(1)).alias("_n")).select(
        *[F.col(c).alias(f"_b{i}") for i, c in enumerate(block)], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift")
    )
    numbered = df.withColumn("_at", F.row_number().over(Window.partitionBy(*block).orderBy(*order)))
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_b{i}")) for i, c in enumerate(block)])
    return numbered.join(shift, same).withColumn(name, F.col("_shift") + F.col("_at") - 1).drop("_at", "_shift", *shift.columns[:-1])


TASK_ROWS = 1_500_000


def tasks_for(table: DataFrame) -> int:
    """Number of tasks that get about TASK_ROWS rows of a given table each, and one per core at least.

    Adaptive execution merges partitions by their compressed bytes, so narrow rows meet in few tasks, and it cannot add any: for rows that are
    sorted or gathered the number is asked for by ``repartition``, which is kept. The count reads the footers of the files only.
    """
    n = -(-table.count() // TASK_ROWS)
    return max(n, table.sparkSession.sparkContext.defaultParallelism)


def over_all(column: str) -> Column:
    """Total of a column over a small grouped result (one row per label, family or template)."""
    return F.sum(column).over(Window.partitionBy(F.lit(1)))


def where_late(df: DataFrame, condition: Column) -> DataFrame:
    """Filter rows above staged columns.

    The optimizer writes a plain filter out in terms of the scan's columns, which for long chains
    of staged text columns multiplies the work. The row id ties the filter to its place.
    """
    marked = df.withColumn("_row", F.monotonically_increasing_id())
    return marked.where(condition & (F.col("_row") >= 0)).drop("_row")


def first_rows(df: DataFrame, keys: list[str], order: list, n: int, name: str = "rn") -> DataFrame:
    """First ``n`` rows per group in the given order, with their rank.

    For a constant ``n`` Spark puts a group limit below the shuffle (WindowGroupLimit), so
    every map task sends at most ``n`` rows per group and a hot group stays small.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= n)


PLACES = 9  # decimal places that exact sums keep


def exact_sum(value: Column) -> Column:
    """Sum of doubles in fixed point (PLACES decimals): the same however the rows are ordered or partitioned."""
    return F.sum(F.round(value * 10.0**PLACES).cast("decimal(28,0)"))


def exact_mean(value: Column) -> Column:
    """Mean of doubles by ``exact_sum``, for decisions at a threshold; null without values.

    An average of doubles depends in its last bit on the order of addition, so a mean that should equal the threshold falls on either side.
    """
    return F.try_divide(exact_sum(value).cast("double") / 10.0**PLACES, F.count(value))


PARTS = 256  # bins of each power of two, where the value range of a group is not known


def ranked_histogram(
    df: DataFrame,
    keys: list[str],
    value: str,
    weights: dict[str, Column],
    bins: int = 512,
    low: float | None = None,
    high: float | None = None,
) -> DataFrame:
    """Distinct values per group with aggregate weights, ``below_<w>`` and ``total_<w>``.

    ``below_<w>`` sums the weight over strictly smaller values of the group. Rows are first
    reduced to distinct values; these are cut into value bins so that the running sums of a
    group run in up to ``bins`` tasks, and the bin totals (at most ``bins`` rows per group)
    give the offsets. With ``low``/``high`` the range is known (a score) and the bins are equally wide; else a bin is
    the 256th part of a power of two, so that heavy tails fill no single bin and no range has to be measured.
    """
    names = list(weights)
    hist = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        *[agg.alias(name) for name, agg in weights.items()]
    )
    if low is None:
        size = F.abs(F.col(value).cast("double"))
        power = F.floor(F.log2(size))
        place = (power + 1100) * PARTS + F.floor((size / F.pow(F.lit(2.0), power) - 1) * PARTS) + 1
        hist = hist.withColumn("_bin", F.when(size == 0, 0).otherwise(F.signum(F.col(value).cast("double")) * place).cast("bigint"))
    else:
        share = (F.col(value) - float(low)) / (float(high) - float(low))
        hist = hist.withColumn("_bin", F.floor(share * bins))
    before = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = (
        hist.groupBy(*keys, "_bin")
        .agg(*[F.sum(n).alias(f"_s_{n}") for n in names])
        .select(
            *keys,
            "_bin",
            *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in names],
            *[F.sum(f"_s_{n}").over(whole).alias(f"total_{n}") for n in names],
        )
    )
    within = Window.partitionBy(*keys, "_bin").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    for n in names:
        hist = hist.withColumn(f"_w_{n}", F.coalesce(F.sum(n).over(within), F.lit(0)))
    joined = hist.join(offsets, [*keys, "_bin"])
    return joined.select(
        *keys,
        value,
        *names,
        *[(F.col(f"_w_{n}") + F.col(f"_o_{n}")).alias(f"below_{n}") for n in names],
        *[f"total_{n}" for n in names],
    )


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float], weight: str | None = None, also: dict[str, Column] | None = None, **ranges
) -> DataFrame:
    """Linear-interpolated quantiles per group from the ranked histogram; no group is gathered.

    ``weight`` is the number of rows that a row stands for. ``also`` are further aggregates over the distinct values, of which each stands for ``n`` rows.
    """
    also = also or {}
    ranked = ranked_histogram(df, keys, value, {"n": F.count(F.lit(1)) if weight is None else F.sum(weight)}, **ranges)
    picks = []
    for name, q in quantiles.items():
        pos = F.lit(float(q)) * (F.col("total_n") - 1)
        holds = lambda at: (F.col("below_n") <= at) & (at < F.col("below_n") + F.col("n"))
        picks.append(F.max(F.when(holds(F.floor(pos)), F.col(value))).alias(f"_lo_{name}"))
        picks.append(F.max(F.when(holds(F.ceil(pos)), F.col(value))).alias(f"_hi_{name}"))
    grouped = ranked.groupBy(*keys).agg(F.max("total_n").alias("_n"), *picks, *[c.alias(name) for name, c in also.items()])
    out = []
    for name, q in quantiles.items():
        pos = F.lit(float(q)) * (F.col("_n") - 1)
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((low + (high - low) * (pos - F.floor(pos))).cast("double").alias(name))
    return grouped.select(*keys, *out, *also)
