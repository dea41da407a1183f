"""Monitoring statistics over a table of records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.ranks import ranked
from tessera.plans.skew import grouped


def micros(time: str | Column) -> Column:
    """Microseconds since 1970 of a timestamp without time zone; one with a zone is taken in the session's."""
    time = F.col(time) if isinstance(time, str) else time
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), time.cast("timestamp_ntz"))


PERCENTILES = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p999": 0.999}


def percentiles(rows: DataFrame, value: str, by: Sequence[str] = (), points: dict[str, float] = PERCENTILES) -> DataFrame:
    """Exact percentiles, interpolated between neighbours; null values don't count.

    Values get their places in the group's order, and the two at either side of each percentile are
    picked: no group's values are held in one place.
    """
    placed = ranked(rows.where(F.col(value).isNotNull()).select(*by, value), by, [value], "_k", "_n")
    out = []
    for name, p in points.items():
        at = F.lit(p) * (F.col("_n") - 1) + 1
        low = F.max(F.when(F.col("_k") == F.floor(at), F.col(value)))
        high = F.max(F.when(F.col("_k") == F.ceil(at), F.col(value)))
        share = F.max(at - F.floor(at))
        out.append((low + (high - low) * share).alias(name))
    return placed.groupBy(*by).agg(*out)


def mean(value: str | Column) -> Column:
    """The mean, 0 of nothing."""
    return F.coalesce(F.avg(value), F.lit(0.0))


def deviation(value: str | Column) -> Column:
    """The sample standard deviation, 0 of one value or none."""
    return F.coalesce(F.stddev_samp(value), F.lit(0.0))


def anomalies(rows: DataFrame, value: str, by: Sequence[str] = (), sigmas: float = 3.0, least: int = 10) -> DataFrame:
    """Rows further from their group's mean than ``sigmas`` sample deviations; groups of ``least`` rows or more.

    The groups' figures are aggregated and joined back: no window over all rows.
    """
    keys = list(by)
    figures = [F.count("*").alias("_n"), F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_dev")]
    if keys:
        both = rows.join(grouped(rows, keys, *figures), keys)
    else:
        one = rows.agg(*figures).first()
        both = rows.withColumns({c: F.lit(one[c]) for c in ("_n", "_mean", "_dev")})
    return both.where((F.col("_n") >= least) & (F.abs(F.col(value) - F.col("_mean")) > sigmas * F.col("_dev"))).drop("_n", "_mean", "_dev")


def insights(rows: DataFrame, by: str, value: str) -> DataFrame:
    return rows.groupBy(by).agg(
        F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"), deviation(value).alias("deviation")
    )


def latest(rows: DataFrame, by: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The last ``n`` rows of each group by ``order``."""
    w = Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def trend(rows: DataFrame, by: str, order: Sequence[str], latency: str, quality: str, least: int = 10) -> DataFrame:
    """``by``, ``latency_change``, ``quality_change`` (percent, second half against the first) and ``trend``."""
    halves = ranked(rows, [by], order, "_k", "_n").where(F.col("_n") >= least)
    late = F.col("_k") > F.floor(F.col("_n") / 2)

    def change(c: str) -> Column:
        a, b = F.avg(F.when(~late, F.col(c))), F.avg(F.when(late, F.col(c)))
        return F.when(a == 0, F.lit(0.0)).otherwise((b - a) / F.nullif(a, F.lit(0.0)) * 100)

    out = halves.groupBy(by).agg(change(latency).alias("latency_change"), change(quality).alias("quality_change"))
    worse = (F.col("latency_change") > 20) | (F.col("quality_change") < -10)
    better = (F.col("latency_change") < -20) | (F.col("quality_change") > 10)
    return out.withColumn("trend", F.when(worse, "degrading").when(better, "improving").otherwise("stable"))


def strategy_ranking(rows: DataFrame, strategy: str, quality: str, milliseconds: str, least: int = 5) -> DataFrame:
    """Strategies with ``least`` records or more by their mean of 0.6 quality + 0.4 / (1 + seconds)."""
    score = 0.6 * F.col(quality) + 0.4 / (1 + F.col(milliseconds) / 1000)
    out = rows.groupBy(strategy).agg(F.count("*").alias("n"), F.avg(score).alias("score")).where(F.col("n") >= least)
    return out.orderBy(F.desc("score"), strategy)


def data_quality(rows: DataFrame, strategy: str, valid: Column, time: str) -> DataFrame:
    """One row: share of valid records, number of strategies, seconds covered and a grade."""
    out = rows.agg(
        F.count("*").alias("n"),
        F.coalesce(F.avg(F.when(valid, 1.0).otherwise(0.0)), F.lit(0.0)).alias("valid_share"),
        F.count_distinct(strategy).alias("strategies"),
        F.coalesce((micros(F.max(time)) - micros(F.min(time))) / 1e6, F.lit(0.0)).alias("seconds"),
    )
    share, kinds = F.col("valid_share"), F.col("strategies")
    grade = F.when((share > 0.95) & (kinds >= 3), "excellent").when((share > 0.8) & (kinds >= 2), "good").when(share > 0.6, "fair").otherwise("poor")
    return out.withColumn("grade", grade)


def metric_kinds(rows: DataFrame, name: str, value: str, order: Sequence[str]) -> DataFrame:
    """A row for each metric: counters are summed, gauges keep their last value, others are described.

    Names that end in ``_total`` or ``_count`` are counters, in ``_usage`` or ``_bytes`` gauges.
    """
    n = F.col(name)
    kind = F.when(n.endswith("_total") | n.endswith("_count"), "counter").when(n.endswith("_usage") | n.endswith("_bytes"), "gauge").otherwise("histogram")
    out = rows.withColumn("kind", kind).groupBy(name, "kind").agg(
        F.count("*").alias("n"), F.sum(value).alias("total"), F.max_by(value, F.struct(*order)).alias("last"),
        F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"),
    )
    current = F.when(F.col("kind") == "counter", F.col("total")).when(F.col("kind") == "gauge", F.col("last")).otherwise(F.col("mean"))
    return out.withColumn("value", current)


def moving_average(rows: DataFrame, by: Sequence[str], order: Sequence[str], value: str, weight: float = 0.1) -> DataFrame:
    """The exponential average of each group at its end: the first value, then (1 - weight) old + weight new.

    With n rows, the row at place i counts weight * (1 - weight) ** (n - 1 - i), the first one without
    its weight; so it takes the places and one sum, with no ordered list of a group.
    """
    placed = ranked(rows, by, order, "_at", "_n")
    part = F.col(value) * F.pow(F.lit(1 - weight), F.col("_n") - F.col("_at")) * F.when(F.col("_at") == 1, 1.0).otherwise(weight)
    return placed.groupBy(*by).agg(F.count("*").alias("n"), F.sum(part).alias("average"))


def histogram(rows: DataFrame, value: str, width: float) -> DataFrame:
    """``low`` and ``n`` for each bar of ``width``."""
    return rows.groupBy((F.floor(F.col(value) / width) * width).alias("low")).agg(F.count("*").alias("n"))


def alerts(rows: DataFrame, by: Sequence[str], time: str, firing: Column, gap_seconds: float) -> DataFrame:
    """Rows that fire and whose predecessor that fires is at least ``gap_seconds`` older.

    The gap is to the row before, not to the last alert given; ``tessera.streaming.limits`` has the
    cooldown that depends on alerts given.
    """
    w = Window.partitionBy(*by).orderBy(time)
    fired = rows.where(firing).withColumn("_before", F.lag(time).over(w))
    gap = micros(time) - micros("_before")
    return fired.where(F.col("_before").isNull() | (gap >= gap_seconds * 1e6)).drop("_before")


def context_similarity(count: Column, dimension: Column, hours: Column, now_count: int, now_dimension: int) -> Column:
    """How alike a record's situation is to the present one, from 0 to 1."""

    def near(a: Column, b: int) -> Column:
        most = F.greatest(a.cast("double"), F.lit(float(b)))
        return F.when((a > 0) & F.lit(b > 0), 1 - F.abs(a - F.lit(b)) / F.nullif(most, F.lit(0.0))).when(a == F.lit(b), 1.0).otherwise(0.1)

    def ratio(a: Column, b: int) -> Column:
        return F.greatest(a.cast("double"), F.lit(float(b))) / F.greatest(F.lit(1.0), F.least(a.cast("double"), F.lit(float(b))))

    far = (ratio(count, now_count) > 10) | (ratio(dimension, now_dimension) > 2)
    value = 0.5 * near(count, now_count) + 0.3 * near(dimension, now_dimension) + 0.2 * F.exp(-hours / 24.0)
    return F.when(far, 0.1).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def pick_strategy(rows: DataFrame, strategy: str, score: Column, similarity: Column, least: int = 2) -> DataFrame:
    """The strategy with the best mean of score * similarity: over records with a similarity above 0.7,
    or above 0.3 where no strategy has ``least`` of those."""
    out = None
    for level, bound in enumerate((0.7, 0.3)):
        some = rows.where(similarity > bound).groupBy(strategy).agg(F.count("*").alias("n"), F.avg(score * similarity).alias("score"))
        some = some.where(F.col("n") >= least).withColumn("level", F.lit(level))
        out = some if out is None else out.unionByName(some)
    return out.orderBy("level", F.desc("score"), strategy).limit(1)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``name`` and ``n`` for each table, and their sum under a null name."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out.rollup("name").agg(F.sum("n").alias("n"))
