"""Analytics of experiment results: normalisation, descriptions, regression, errors."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions.expr import col
from emberline.lineage import cut

SHORT_LIST = 10_000


def normalize(df: DataFrame, by: list[str], columns: list[str], prefix: str = "Normalized") -> DataFrame:
    """Each column over its largest value in the group. The groups' maxima come from partial aggregates, and a group of
    very many rows is joined with its one row, which Spark's skew join can split."""
    top = df.groupBy(*by).agg(*[F.max(c).alias(f"_top_{c}") for c in columns])
    return _with_groups(df, top, by).select(*df.columns, *[(F.col(c) / F.nullif(F.col(f"_top_{c}"), F.lit(0))).alias(f"{prefix}{c}") for c in columns])


def _with_groups(df: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """df joined with one row for each group; null keys are a group too."""
    renamed = groups.select(*[F.col(c).alias(f"_by_{c}") for c in by], *[c for c in groups.columns if c not in by])
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return df.join(renamed, same).drop(*[f"_by_{c}" for c in by])


def order_points(df: DataFrame, by: list[str], column: str, points: tuple[float, ...]) -> DataFrame:
    """(by, point, value): exact quantiles, linear between ranks, without a task that holds a group.

    Equal values are counted first. The counted values are dealt by range; counts of the ranges give the rank at which
    each range begins, so only values at the wanted ranks are gathered, two for each point."""
    counted = df.where(F.col(column).isNotNull()).groupBy(*by, F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    ranged = cut(counted.repartitionByRange(*by, "_v").withColumn("_part", F.spark_partition_id()))
    sums = ranged.groupBy(*by, "_part").agg(F.sum("_n").alias("_sum"))  # as many rows as ranges and groups
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy(*by)
    offsets = sums.select(*by, "_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"), F.sum("_sum").over(total).alias("_total"))
    within = Window.partitionBy("_part", *by).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = _with_groups(ranged.withColumn("_end", F.sum("_n").over(within)), offsets, [*by, "_part"])
    first, last = F.col("_offset") + F.col("_end") - F.col("_n"), F.col("_offset") + F.col("_end") - 1
    at = F.array(*[F.struct(F.lit(float(p)).alias("point"), (F.lit(float(p)) * (F.col("_total") - 1)).alias("rank")) for p in points])
    wanted = ranked.select(*by, "_v", first.alias("_first"), last.alias("_last"), F.explode(at).alias("_at"))
    low, high = F.floor("_at.rank"), F.ceil("_at.rank")
    hit = wanted.where(((low >= F.col("_first")) & (low <= F.col("_last"))) | ((high >= F.col("_first")) & (high <= F.col("_last"))))
    share = F.col("_at.rank") - low
    return hit.groupBy(*by, F.col("_at.point").alias("point")).agg((F.min("_v") + F.first(share) * (F.max("_v") - F.min("_v"))).alias("value"))


def head(df: DataFrame, by: list[str], order: list, n: int = 10) -> DataFrame:
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")


def describe(df: DataFrame, by: list[str], column: str, digits: int | None = None) -> DataFrame:
    """count, mean, std (sample), min, quartiles (linear between ranks) and max for each group."""
    c = F.col(column)
    out = df.groupBy(*by).agg(F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"))
    named = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    found = order_points(df, by, column, tuple(named.values()))
    quartiles = found.groupBy(*by).agg(*[F.max(F.when(F.col("point") == p, F.col("value"))).alias(n) for n, p in named.items()])
    none = out.where("count = 0").select(*by, *[F.lit(None).cast("double").alias(n) for n in named])
    shown = lambda x, n: (F.round(x, digits) if digits is not None else x).alias(n)
    return _with_groups(out, quartiles.unionByName(none), by).select(*by, "count", shown(F.col("mean"), "mean"), shown(F.col("std"), "std"), "min", *[shown(F.col(n), n) for n in named], "max")


def quantiles(df: DataFrame, columns: list[str], points: tuple[float, ...] = (0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """A row for each quantile: quantile and the columns, null for a column without values."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns])).alias("_c")).select("_c.name", "_c.value")
    found = order_points(long, ["name"], "value", points).select("name", "point", F.col("value").alias("_value"))
    every = df.sparkSession.createDataFrame([(float(p),) for p in points], "quantile double")
    out = every.join(F.broadcast(found), F.col("quantile") == F.col("point"), "left")  # one row for each column and point
    return out.groupBy("quantile").agg(*[F.max(F.when(F.col("name") == c, F.col("_value"))).alias(c) for c in columns])


def t_quantile(p: float, df: int) -> float:
    """Quantile of Student's t for p > 0.5, by bisection on its distribution function."""

    def beta_inc(a: float, b: float, x: float) -> float:
        if x <= 0 or x >= 1:
            return 0.0 if x <= 0 else 1.0
        if x > (a + 1) / (a + b + 2):
            return 1 - beta_inc(b, a, 1 - x)
        front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
        # modified Lentz evaluation of the continued fraction
        c, d = 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d if abs(d) > 1e-300 else 1e-300)
        total = d
        for m in range(1, 500):
            for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 + top * d
                d = 1 / (d if abs(d) > 1e-300 else 1e-300)
                c = 1 + top / c
                c = c if abs(c) > 1e-300 else 1e-300
                total *= c * d
            if abs(c * d - 1) < 1e-15:
                break
        return front * total

    cdf = lambda t: 1 - 0.5 * beta_inc(df / 2, 0.5, df / (df + t * t))
    low, high = 0.0, 1.0
    while cdf(high) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return (low + high) / 2


def regression(df: DataFrame, x: str, y: str, confidence: float = 0.95) -> DataFrame:
    """One row: n, slope, intercept, r, slope_err, intercept_err, and half widths of their confidence intervals.

    The sums are one row, which the driver reads for the quantile of t."""
    n, sxx, syy, sxy = F.regr_count(y, x), F.regr_sxx(y, x), F.regr_syy(y, x), F.regr_sxy(y, x)
    sums = df.agg(n.alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(y, x).alias("r"), sxx.alias("sxx"), syy.alias("syy"), sxy.alias("sxy"), F.regr_avgx(y, x).alias("mx"))
    rest = F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), F.lit(0.0)) / F.nullif(F.col("n") - 2, F.lit(0))
    out = sums.withColumn("slope_err", F.sqrt(rest / F.col("sxx"))).withColumn("intercept_err", F.col("slope_err") * F.sqrt(F.col("sxx") / F.col("n") + F.col("mx") * F.col("mx")))
    names = ("n", "slope", "intercept", "r", "slope_err", "intercept_err")
    held = out.withColumn("slope_err", F.when(F.col("n") > 2, F.col("slope_err"))).withColumn("intercept_err", F.when(F.col("n") > 2, F.col("intercept_err"))).select(*names).first()
    t = t_quantile(0.5 + confidence / 2, held["n"] - 2) if held["n"] > 2 else float("nan")
    half = [None if held[c] is None else held[c] * t for c in ("slope_err", "intercept_err")]
    return df.sparkSession.createDataFrame([(*held, *half)], "n long, slope double, intercept double, r double, slope_err double, intercept_err double, slope_ci double, intercept_ci double")


def sem(column: Column | str) -> Column:
    """Standard error of the mean."""
    return F.stddev_samp(col(column)) / F.sqrt(F.count(col(column)))


def ratio_error(a: Column | str, b: Column | str, a_err: Column | str, b_err: Column | str) -> Column:
    """Error of a / b."""
    return F.abs(col(a) / col(b)) * F.sqrt(F.pow(col(a_err) / col(a), F.lit(2.0)) + F.pow(col(b_err) / col(b), F.lit(2.0)))


def combined_error(column: Column | str) -> Column:
    """Error of a mean of values with the given errors."""
    return F.sqrt(F.sum(col(column) * col(column))) / F.count(col(column))


def histogram(df: DataFrame, by: list[str], column: str, count: str | None = None) -> DataFrame:
    """Share of each value in its group. count: a column that says for how many rows a row stands."""
    counted = df.groupBy(*by, column).agg((F.sum(count) if count else F.count(F.lit(1))).alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def parameter_grid(spark, tolerances: list[float], transmissions: list[float]) -> DataFrame:
    """Every pair of two short lists."""
    a = spark.createDataFrame([(float(t),) for t in tolerances], "tol double")
    b = spark.createDataFrame([(float(t),) for t in transmissions], "transmission double")
    return a.crossJoin(F.broadcast(b))


def pair_combinations(items: DataFrame, key: str) -> DataFrame:
    """Unordered pairs of a short list's items; SHORT_LIST of them at most."""
    if items.limit(SHORT_LIST + 1).count() > SHORT_LIST:
        raise ValueError(f"pair_combinations is for lists of up to {SHORT_LIST} items")
    a, b = items.select(F.col(key).alias("a")), items.select(F.col(key).alias("b"))
    return a.join(b, F.col("a") < F.col("b"))


def union_runs(**frames: DataFrame) -> DataFrame:
    """Rows of several frames with the frame's name in Graph."""
    out = None
    for name, df in frames.items():
        named = df.withColumn("Graph", F.lit(name))
        out = named if out is None else out.unionByName(named)
    return out
