"""Simulated paths, risk, and what-if scenarios as multipliers on a baseline (series_id, h, point)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import norm_quantile


def simulate_paths(spark: SparkSession, last: float, trend: float, sd: float, horizon: int, sims: int = 10_000, seed: int = 1) -> DataFrame:
    """(sim, h, value): random walks with drift. Draws depend on (seed, sim, h) alone, not on partitions."""
    grid = spark.range(sims).select(F.col("id").alias("sim"), F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h"))
    uniform = lambda salt: (F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "sim", "h"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    normal = F.sqrt(-2 * F.ln(uniform(0))) * F.cos(2 * F.pi() * uniform(1))
    step = grid.withColumn("step", trend + sd * normal)
    return step.select("sim", "h", (last + F.sum("step").over(Window.partitionBy("sim").orderBy("h"))).alias("value"))


def walk_of(points: DataFrame) -> tuple[float, float, float]:
    """(last value, mean step, deviation of the steps) of one series, from which its walks go on."""
    by_idx = Window.partitionBy("series_id").orderBy("idx")
    steps = points.withColumn("step", F.col("value") - F.lag("value").over(by_idx))
    return tuple(steps.agg(F.max_by("value", "idx"), F.avg("step"), F.stddev_samp("step")).head())


def joint_bands(paths: DataFrame, horizon: int, confidence: float = 0.95) -> DataFrame:
    """(h, low, high, mean, bonferroni_low, bonferroni_high)."""
    z = norm_quantile(1 - (1 - confidence) / (2 * horizon))
    v = F.col("value")
    out = paths.groupBy("h").agg(F.min(v).alias("low"), F.max(v).alias("high"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"))
    return out.select("h", "low", "high", "mean", (F.col("mean") - z * F.col("sd")).alias("bonferroni_low"), (F.col("mean") + z * F.col("sd")).alias("bonferroni_high"))


def kth_smallest(values: DataFrame, rank: int, few: int = 10_000) -> float:
    """The value of ``rank`` (from 0) among the non-null ones of ``value``, exactly.

    A sketch brackets the rank and one pass counts what lies below and inside; brackets narrow until at most ``few`` rows
    remain or the ends are equal. Where ties keep a bracket from narrowing, its lowest value is taken off. No sort of all
    rows, and two numbers a pass reach the driver."""
    v, inside, below, slack, accuracy = F.col("value"), values.filter("value is not null"), 0, 2.0, 10_000
    while True:
        size = inside.count()
        if size <= few:
            return inside.agg(F.element_at(F.sort_array(F.collect_list(v)), F.lit(rank - below + 1)).alias("v")).head()[0]
        at = (rank - below) / size
        shares = [min(1.0, max(0.0, at + side * slack / accuracy)) for side in (-1, 1)]
        low, high = inside.agg(F.percentile_approx(v, F.array(*map(F.lit, shares)), F.lit(accuracy)).alias("q")).head()[0]
        less, between = inside.agg(F.count_if(v < low), F.count_if(v.between(low, high))).head()
        if not less <= rank - below < less + between:
            slack *= 2
            continue
        if low == high:
            return low
        if between < size:
            inside, below = inside.filter(v.between(low, high)), below + less
            continue
        same = inside.filter(v == low).count()
        if rank - below < same:
            return low
        inside, below = inside.filter(v > low), below + same


def risk(values: DataFrame, confidence: float = 0.95) -> DataFrame:
    """One row: value at risk (rank floor(n·(1 - c))), mean at or below it, share below zero. Nulls don't count; of no values all are null."""
    v = F.col("value")
    n = values.filter("value is not null").count()
    var = F.lit(kth_smallest(values, int(n * (1 - confidence))) if n else None).cast("double")
    return values.agg(F.max(var).alias("var"), F.avg(F.when(v <= var, v)).alias("cvar"), F.avg((v < 0).cast("double")).alias("p_negative"))


def scenario_tree(base: DataFrame, scenarios: list[tuple[str, float, str, float]]) -> DataFrame:
    """(series_id, h, base, expected): 0.6·base + sum of probability·scenario, probabilities normalised to 0.4; kinds multiplicative, additive."""
    s = base.sparkSession.createDataFrame(scenarios, "name string, p double, kind string, amount double")
    s = s.withColumn("p", 0.4 * F.col("p") / F.sum("p").over(Window.partitionBy(F.lit(0))))
    v = F.when(F.col("kind") == "multiplicative", F.col("point") * F.col("amount")).otherwise(F.col("point") + F.col("amount"))
    return base.crossJoin(F.broadcast(s)).groupBy("series_id", "h").agg(F.first("point").alias("base"), (0.6 * F.first("point") + F.sum(F.col("p") * v)).alias("expected"))


def multiplier(kind: str, i: Column, elasticity: float = -1.2) -> Column:
    """Factor of day ``i`` (from 0) of the scenarios of price, promotion, shock and supply."""
    week = F.floor(i / 7)
    promo = F.lit(0.0)
    for start in (3, 17, 31):
        promo += F.when((i >= start) & (i < start + 3), 2.5 * F.pow(F.lit(0.6), i - start)).otherwise(0.0)
    raised = 0.05 * F.least(week + 1, F.lit(6))
    cut = F.when(week == 0, -0.05).when(week == 1, -0.10).otherwise(-0.15)
    return {
        "price_increase": 1 + elasticity * (1 + 0.5 * raised) * raised,
        "price_decrease": 1 + elasticity * cut,
        "regular_promotion": F.when(i % 30 < 7, 1.25).otherwise(1.0),
        "flash_sale": 1 + promo,
        "stacked_promotions": F.when(week == 1, 2.5).when(week == 2, 2.0).when(week == 3, 1.8).otherwise(1.0),
        "short_delay": F.when(i < 3, 0.6).otherwise(1.0),
        "long_outage": F.when(i < 14, 0.2).when(i < 21, 0.6).otherwise(1.0),
        "natural_disaster": F.greatest(F.lit(0.1), 1 - 0.5 * (1 + i / 30)),
    }[kind]


SCENARIOS = ("price_increase", "price_decrease", "regular_promotion", "flash_sale", "stacked_promotions", "short_delay", "long_outage", "natural_disaster")


def what_if(base: DataFrame, kinds: tuple[str, ...] = SCENARIOS, elasticity: float = -1.2) -> DataFrame:
    """(series_id, scenario, h, base, adjusted, cumulative difference)."""
    one = F.array(*(F.struct(F.lit(k).alias("scenario"), multiplier(k, F.col("h") - 1, elasticity).alias("m")) for k in kinds))
    out = base.withColumn("s", F.explode(one)).select("series_id", "s.scenario", "h", F.col("point").alias("base"), (F.col("point") * F.col("s.m")).alias("adjusted"))
    w = Window.partitionBy("series_id", "scenario").orderBy("h")
    return out.withColumn("cumulative", F.sum(F.col("adjusted") - F.col("base")).over(w))


def capacity_limited(demand: DataFrame, capacity: float) -> DataFrame:
    """(series_id, served, lost, utilisation)."""
    v = F.col("value")
    return demand.groupBy("series_id").agg(F.sum(F.least(v, F.lit(capacity))).alias("served"), F.sum(F.greatest(v - capacity, F.lit(0.0))).alias("lost"), F.avg(F.least(v / capacity, F.lit(1.0))).alias("utilisation"))


def cross_elasticity(prices: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., elasticity, relation) from rows (by..., t, price_b, quantity_a): slope of changes of quantity over changes of price.

    Each pair of products named by ``by`` is a series of its own; without ``by`` there is one."""
    w = Window.partitionBy(*(by or (F.lit(0),))).orderBy("t")
    change = lambda c: F.try_divide(F.col(c) - F.lag(c).over(w), F.lag(c).over(w))
    e = prices.select(*by, change("price_b").alias("p"), change("quantity_a").alias("q")).dropna(subset=["p", "q"]).groupBy(*by).agg(F.regr_slope("q", "p").alias("elasticity"))
    return e.withColumn("relation", F.when(F.col("elasticity") > 0.1, "substitute").when(F.col("elasticity") < -0.1, "complementary").otherwise("independent"))
