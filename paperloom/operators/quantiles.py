"""Exact quantiles of groups of any size, by narrowing brackets instead of gathering values.

Each wanted rank of a group has a bracket of values that holds it. A round deals a bracket's values to bins of equal width,
counts them where they are (partial counts before the shuffle, at most BINS a bracket), and takes the bin that holds the
rank, with its own least and greatest value, as the next bracket. When a bracket holds one value only, or few rows, its
values are counted one by one and the rank is read off. A group of all rows is spread over all tasks in every round; no
task gets more than BINS counts, or FEW rows, of a bracket. Each round is a scan of the input, so pass a written table.

Null values and those that aren't finite are left out; groups without any other have null quantiles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.session import cut

BINS = 4096
FEW = 10_000
#: Brackets up to which they are broadcast to the values; beyond it the join shuffles.
BRACKETS_BROADCAST = 500_000


def _side(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BRACKETS_BROADCAST else df


def ranked(values: DataFrame, wanted: DataFrame) -> DataFrame:
    """(g, rank, v): the value of each wanted rank, from (g, v) and (g, rank, skip, low, high, n), where ``n`` values of the
    group lie in the bracket and ``skip`` below it; ranks count from 0."""
    done = None
    wanted = cut(wanted)
    while True:
        found = wanted.filter("low = high OR n = 1").select("g", "rank", F.col("low").alias("v"))
        done = found if done is None else done.union(found)
        # so narrow a bracket that its bins have no width holds few values, however many rows
        narrow = F.col("high") / BINS - F.col("low") / BINS <= 0
        wanted = wanted.filter("low < high AND n > 1")
        few = wanted.filter((F.col("n") <= FEW) | narrow)
        wanted = wanted.filter(~((F.col("n") <= FEW) | narrow))
        if not few.isEmpty():
            done = done.union(_read_off(values, few))
        if wanted.isEmpty():
            return done
        wanted = cut(_narrowed(values, wanted))


def _inside(values: DataFrame, brackets: DataFrame) -> DataFrame:
    keys = cut(brackets.select(F.col("g").alias("of"), "low", "high").distinct())
    return values.join(_side(keys), values.g.eqNullSafe(F.col("of")) & values.v.between(F.col("low"), F.col("high"))).drop("of")


def _narrowed(values: DataFrame, wanted: DataFrame) -> DataFrame:
    width = F.col("high") / BINS - F.col("low") / BINS
    bin_ = F.least(F.floor(F.when(width > 0, (F.col("v") - F.col("low")) / width).otherwise(0)), F.lit(BINS - 1))
    counts = _inside(values, wanted).withColumn("bin", bin_).groupBy("g", "low", "high", "bin").agg(F.count("*").alias("n_bin"), F.min("v").alias("least"), F.max("v").alias("most"))
    before = F.sum("n_bin").over(Window.partitionBy("g", "low", "high").orderBy("bin")) - F.col("n_bin")
    bins = counts.withColumn("before", before).withColumnsRenamed({"g": "of", "low": "of_low", "high": "of_high"})
    same = F.col("g").eqNullSafe(F.col("of")) & (F.col("low") == F.col("of_low")) & (F.col("high") == F.col("of_high"))
    at = F.col("rank") - F.col("skip")
    held = wanted.join(bins, same & (F.col("before") <= at) & (at < F.col("before") + F.col("n_bin")))
    return held.select("g", "rank", (F.col("skip") + F.col("before")).alias("skip"), F.col("least").alias("low"), F.col("most").alias("high"), F.col("n_bin").alias("n"))


def _read_off(values: DataFrame, wanted: DataFrame) -> DataFrame:
    counts = _inside(values, wanted).groupBy("g", "low", "high", "v").agg(F.count("*").alias("n_value"))
    upto = F.sum("n_value").over(Window.partitionBy("g", "low", "high").orderBy("v"))
    each = counts.withColumn("upto", upto).withColumnsRenamed({"g": "of", "low": "of_low", "high": "of_high"})
    same = F.col("g").eqNullSafe(F.col("of")) & (F.col("low") == F.col("of_low")) & (F.col("high") == F.col("of_high"))
    at = F.col("rank") - F.col("skip")
    return wanted.join(each, same & (F.col("upto") - F.col("n_value") <= at) & (at < F.col("upto"))).select("g", "rank", "v")


def quantiles(rows: DataFrame, by: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(by, …): a column for each named share between 0 and 1, interpolated between neighbouring ranks."""
    number = F.col(value).cast("double")
    values = rows.select(F.col(by).alias("g"), number.alias("v"))
    finite = values.filter("v IS NOT NULL AND NOT isnan(v) AND abs(v) <= 1.7976931348623157E308D")
    bounds = cut(finite.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")))
    place = lambda share: F.lit(share) * (F.col("n") - 1)
    ranks = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(place(s)), F.ceil(place(s))) for s in shares.values()))))
    found = ranked(finite, bounds.select("g", F.explode(ranks).alias("rank"), F.lit(0).cast("long").alias("skip"), "low", "high", "n"))
    table = found.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at")).withColumnRenamed("g", "of")
    joined = bounds.join(table, F.col("g").eqNullSafe(F.col("of")))
    out = []
    for name, share in shares.items():
        low, high = F.col("at")[F.floor(place(share))], F.col("at")[F.ceil(place(share))]
        part = place(share) - F.floor(place(share))
        out.append(F.when(low == high, low).otherwise((1 - part) * low + part * high).alias(name))
    named = joined.select("g", *out).withColumnRenamed("g", "of")
    groups = values.select("g").distinct()
    return groups.join(named, F.col("g").eqNullSafe(F.col("of")), "left").select(F.col("g").alias(by), *shares)
