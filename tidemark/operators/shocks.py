"""Scenarios of shocks, policies, prices, promotions and supply, as expressions over the days of a base forecast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: what the scenarios assume
SECTOR_DEPTH = {"retail": 0.4, "travel": 0.7, "e-commerce": 0.1}
CATEGORY_ELASTICITY = {"grocery": -1.2, "electronics": -0.8, "clothing": -1.5, "luxury": -0.5, "basics": -0.3, "promotional": -2.0, "subscription": -0.4}
COUNTRY_RISK = {"china": 0.15, "russia": 0.25, "iran": 0.2, "north-korea": 0.3}
#: probability, scale of impact, days of warning
RISKS = {"pandemic": (0.1, 3.0, 7), "weather": (0.4, 1.5, 3), "policy": (0.6, 1.2, 30), "natural-disaster": (0.15, 2.0, 1), "other": (0.3, 1.0, 7)}


def pandemic(i: Column, sector: str) -> Column:
    """A ramp of 60 days, 90 days of lockdowns in every third fortnight, slow recovery from day 150."""
    depth = SECTOR_DEPTH.get(sector, 0.3)
    slow = 1 + depth * 0.3 * (1 - F.exp(-0.01 * (i - 150)))
    return F.when(i < 60, 1 - depth * F.least(F.lit(1.0), (i + 1) / 60)).when(i < 150, F.when(F.floor(i / 14) % 3 == 0, 0.7).otherwise(1.0)).when(i < 330, slow).otherwise(1.0)


def policy(i: Column, n: Column, industry: str) -> Column:
    """Tariffs at once, subsidies in three phases; other policies, or days after the third phase, change nothing."""
    if industry == "imports":
        return F.lit(1 - 0.8 * 0.2)
    if industry in ("renewables", "agriculture"):
        phase = F.floor(i / F.floor(n / 3))
        return F.when(phase < 3, 1 + 1.15 * (phase + 1) / 3).otherwise(1.0)
    return F.lit(1.0)


def geopolitical(i: Column, partners: dict[str, float]) -> Column:
    """A cascade of 90 days by the risk of partners of more than a tenth of trade."""
    tariff = sum(COUNTRY_RISK[c] * share for c, share in partners.items() if c in COUNTRY_RISK and share > 0.1)
    phase = F.least(F.lit(1.0), i / 30)
    return F.when(i < 90, (1 - 0.05 * phase) * (1 - tariff * phase)).otherwise(1.0)


def weather(i: Column, start: int, days: int, severity: float) -> Column:
    """From ``start`` for some days, less by the severity, which fades by a tenth a day."""
    return F.when((i >= start) & (i < start + days), 1 - severity * F.pow(F.lit(0.9), i - start)).otherwise(1.0)


def seasonal_promotion(i: Column, lifts: list[tuple[int, float]]) -> Column:
    """Weeks with the lifts of all their holidays."""
    weeks: dict[int, float] = {}
    for week, lift in lifts:
        weeks[week] = weeks.get(week, 0.0) + lift
    out = F.lit(1.0)
    for week, lift in weeks.items():
        out = F.when(F.floor(i / 7) == week, 1 + lift).otherwise(out)
    return out


def shock_scenarios(base: DataFrame, cost: float = 0.5) -> DataFrame:
    """(series_id, idx, scenario, adjusted) of points (series_id, idx, n, value)."""
    i = F.col("idx")
    kinds = {
        "pandemic_retail": pandemic(i, "retail"),
        "pandemic_travel": pandemic(i, "travel"),
        "tariff": policy(i, F.col("n"), "imports"),
        "subsidy": policy(i, F.col("n"), "renewables"),
        "geopolitical": geopolitical(i, {"china": 0.3, "russia": 0.15, "iran": 0.05}),
        "weather": weather(i, 20, 10, 0.4),
        "regulation": F.lit(1 - 0.1 * cost),
        "seasonal_promotion": seasonal_promotion(i, [(2, 0.2), (5, 0.3), (2, 0.1)]),
    }
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("scenario"), (F.col("value") * m).alias("adjusted")) for k, m in kinds.items())))
    return base.select("series_id", "idx", each.alias("s")).select("series_id", "idx", "s.*")


def dynamic_price(base: DataFrame, peaks: tuple[int, ...] = (9, 10, 17, 18)) -> DataFrame:
    """(series_id, idx, adjusted): up or down by 5 % after a change of as much, then 15 % more in peak hours and 10 % less else."""
    trend = F.try_divide(F.col("value"), F.lag("value").over(Window.partitionBy("series_id").orderBy("idx")))
    m = F.when(trend > 1.05, 1.05).when(trend < 0.95, 0.95).otherwise(1.0)
    return base.select("series_id", "idx", (F.col("value") * m * F.when((F.col("idx") % 24).isin(*peaks), 1.15).otherwise(0.9)).alias("adjusted"))


def category_prices(base: DataFrame, products: DataFrame) -> DataFrame:
    """(series_id, category, elasticity, idx, adjusted) for products (series_id, category, promo_weeks): 10 % off in promotion weeks, or 5 % in the first week."""
    e = F.coalesce(*(F.when(F.col("category") == c, v) for c, v in CATEGORY_ELASTICITY.items()), F.lit(-1.0))
    weeks = F.coalesce(F.col("promo_weeks"), F.lit(0))
    off = F.when(weeks > 0, F.when(F.floor(F.col("idx") / 7) < weeks, -0.1).otherwise(0.0)).otherwise(F.when(F.col("idx") < 7, -0.05).otherwise(0.0))
    return base.join(products, "series_id").select("series_id", "category", e.alias("elasticity"), "idx", (F.col("value") * (1 + e * off)).alias("adjusted"))


def cannibalised(totals: DataFrame, promoted: DataFrame) -> DataFrame:
    """(series_id, value, adjusted) for promotions (series_id, budget, related): the promoted gain a fifth for each 1,000, what is only related loses a tenth."""
    gain = promoted.filter("budget > 0").groupBy("series_id").agg(F.max("budget").alias("budget"))
    loss = promoted.filter("budget > 0").select(F.explode("related").alias("series_id")).distinct().withColumn("lost", F.lit(0.9))
    out = totals.join(gain, "series_id", "left").join(loss, "series_id", "left")
    return out.select("series_id", "value", (F.col("value") * F.coalesce(1 + 0.2 * F.col("budget") / 1000, "lost", F.lit(1.0))).alias("adjusted"))


def risks(base: DataFrame) -> DataFrame:
    """(series_id, event, expected_loss, lower, upper, actions) of each kind of event."""
    always = ("Update insurance coverage", "Maintain higher safety stock")

    def one(event: str, p: float, scale: float, days: int) -> Column:
        actions = (["Activate contingency planning", "Secure alternative suppliers"] if scale > 2 else []) + (["Implement early warning monitoring"] if days < 7 else []) + (["Invest in resilience infrastructure"] if p > 0.5 else [])
        return F.struct(F.lit(event).alias("event"), (p * scale * F.col("total")).alias("expected_loss"), F.lit("; ".join([*actions, *always])).alias("actions"))

    total = base.groupBy("series_id").agg(F.sum(F.abs("value")).alias("total"))
    out = total.select("series_id", F.explode(F.array(*(one(k, *v) for k, v in RISKS.items()))).alias("r")).select("series_id", "r.*")
    return out.select("series_id", "event", "expected_loss", (F.col("expected_loss") * 0.5).alias("lower"), (F.col("expected_loss") * 2).alias("upper"), "actions")


def parameter_sweep(totals: DataFrame, prices: tuple[float, ...], volumes: tuple[float, ...], elasticity: float = -1.2) -> DataFrame:
    """(series_id, price, volume, outcome): each total under a grid of relative prices and volumes, with a linear response to the price."""
    grid = F.explode(F.array(*(F.struct(F.lit(p).alias("price"), F.lit(v).alias("volume")) for p in prices for v in volumes)))
    return totals.select("series_id", "value", grid.alias("g")).select("series_id", "g.*", (F.col("value") * (1 + F.col("g.price")) * (1 + elasticity * F.col("g.price")) * (1 + F.col("g.volume"))).alias("outcome"))


def bankrupt_items(supplied: DataFrame, failed: DataFrame) -> DataFrame:
    """(item): what failed suppliers deliver and no other supplier does. ``supplied``: (item, supplier); ``failed``: (supplier)."""
    pairs = supplied.distinct()
    return pairs.join(failed, "supplier", "left_semi").select("item").distinct().join(pairs.join(failed, "supplier", "left_anti"), "item", "left_anti")


def bottlenecks(shipments: DataFrame, routes: DataFrame) -> DataFrame:
    """``shipments`` (route, days, severity) with adjusted and delay, by the routes' congestion (1 where unknown)."""
    adjusted = F.col("days") * (1 + F.coalesce("congestion", F.lit(1.0)) + F.coalesce("severity", F.lit(0.0)))
    return shipments.join(routes, "route", "left").withColumn("adjusted", adjusted).withColumn("delay", F.col("adjusted") - F.col("days")).drop("congestion")
