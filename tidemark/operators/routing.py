"""A forecasting pipeline's first half over many series: quality figures, gates, each series' own repair, and a checked hand-over.

Figures, routes and repairs are windows over one dealing by series: a single plan with one shuffle. What the hand-over is checked by is
observed in the pass that writes.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from tidemark.sources.snapshots import Snapshots


@dataclass(frozen=True)
class Gates:
    """What a series must meet: coverage in percent, long gaps, share of outliers, and points."""

    coverage: float = 95.0
    gaps: int = 1
    outliers: float = 0.05
    least: int = 10
    #: Longest run of missing values that a line may fill; longer ones take the season's mean.
    line: int = 2
    fix: bool = True


def routed(points: DataFrame, gates: Gates = Gates(), season: int = 7) -> DataFrame:  # noqa: B008
    """``points`` (series_id, idx, value, …) with n, missing, gaps, outliers, longest, route, reasons and original; value is repaired by the series' route.

    route: rejected (a gate is not met; reasons name which), clean, linear (mean of the nearest known neighbours), seasonal (mean of the phase, where a run of
    missing values is longer than ``gates.line``; what no phase fills, by neighbours) or unrepaired (holes, and ``gates.fix`` is off)."""
    of, by_idx = Window.partitionBy("series_id"), Window.partitionBy("series_id").orderBy("idx")
    v, hole = F.col("value"), F.col("value").isNull()
    # dealt once, by what all windows below share
    p = points.repartition("series_id").withColumn("_run", F.when(hole, F.col("idx") - F.row_number().over(Window.partitionBy("series_id", hole).orderBy("idx"))))
    run = Window.partitionBy("series_id", "_run")
    p = p.withColumn("_long", F.when(hole, F.count("*").over(run)).otherwise(0)).withColumn("_first", hole & (F.col("idx") == F.min("idx").over(run)))
    p = p.withColumn("_z", F.try_divide(F.abs(v - F.avg(v).over(of)), F.stddev_pop(v).over(of)))
    p = p.withColumns({
        "n": F.count("*").over(of),
        "missing": F.count_if(hole).over(of),
        "gaps": F.count_if(F.col("_first") & (F.col("_long") > 2)).over(of),
        "longest": F.max("_long").over(of),
        "outliers": F.count_if(F.col("_z") > 2.5).over(of),
    })
    known = F.col("n") - F.col("missing")
    checks = {
        "too_short": F.col("n") < gates.least,
        "coverage": 100 * known < gates.coverage * F.col("n"),
        "gaps": F.col("gaps") > gates.gaps,
        "outliers": F.col("outliers") > gates.outliers * F.col("n"),
    }
    reasons = F.array_join(F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in checks.items()))), ",")
    repair = F.when(F.col("longest") > gates.line, "seasonal").otherwise("linear") if gates.fix else F.lit("unrepaired")
    p = p.withColumn("reasons", reasons).withColumn("route", F.when(F.col("reasons") != "", "rejected").when(F.col("missing") == 0, "clean").otherwise(repair))
    left = F.last(v, True).over(by_idx.rowsBetween(Window.unboundedPreceding, -1))
    right = F.first(v, True).over(by_idx.rowsBetween(1, Window.unboundedFollowing))
    line = F.when(left.isNull(), right).when(right.isNull(), left).otherwise((left + right) / 2)
    phase = F.avg(v).over(Window.partitionBy("series_id", F.col("idx") % season))
    fill = F.when(F.col("route") == "linear", F.col("_line")).when(F.col("route") == "seasonal", F.coalesce("_phase", "_line"))
    p = p.withColumn("_line", line).withColumn("_phase", phase).withColumn("original", v).withColumn("value", F.coalesce(v, fill))
    return p.drop("_run", "_long", "_first", "_z", "_line", "_phase")


def routes(done: DataFrame) -> DataFrame:
    """One row per series of ``routed``: series_id, route, reasons, n, missing, gaps, outliers, coverage, repaired, next_step."""
    out = done.groupBy("series_id", "route", "reasons", "n", "missing", "gaps", "outliers").agg(F.count_if(F.col("original").isNull() & F.col("value").isNotNull()).alias("repaired"))
    step = F.when(F.col("route") == "rejected", "inspect").when(F.col("outliers") > 0, "review_outliers").otherwise("forecast")
    return out.withColumn("coverage", F.round(100 * (F.col("n") - F.col("missing")) / F.col("n"), 2)).withColumn("next_step", step)


class Pipeline:
    """Runs of ``routed`` over versions of a collection in ``folder``; a run that fails its checks leaves the version before as the current one."""

    def __init__(self, snapshots: Snapshots, gates: Gates = Gates(), season: int = 7):  # noqa: B008
        self.snapshots, self.gates, self.season = snapshots, gates, season

    def run(self, points: DataFrame, name: str, damage=lambda df: df) -> tuple[dict, DataFrame]:
        """(report, points to go on with) of a collection: a snapshot of what came, the repaired points as the next version unless a check fails, and then the snapshot restored.

        The report has both versions, whether all went well, what failed, and what was observed while writing: rows, known, filled, open (values missing outside rejected series) and
        lost (known values that changed). ``damage`` is applied before writing, for tests of the way back."""
        before = self.snapshots.create(points, name)
        kept = self.snapshots.restore(name, before)
        observed = Observation(f"pipeline-{uuid.uuid4().hex}")
        out = damage(routed(kept, self.gates, self.season))
        value, original = F.col("value"), F.col("original")
        out = out.observe(
            observed,
            F.count(F.lit(1)).alias("rows"),
            F.count(original).alias("known"),
            F.count_if(original.isNull() & value.isNotNull()).alias("filled"),
            F.count_if(value.isNull() & ~F.col("route").isin("rejected", "unrepaired")).alias("open"),
            F.count_if(original.isNotNull() & ~original.eqNullSafe(value)).alias("lost"),
        )
        stage = f"{self.snapshots.folder}/stage-{uuid.uuid4().hex}"
        out.write.partitionBy("route").parquet(stage)
        seen = dict(observed.get)
        rows = self.snapshots.list(name).filter(F.col("version") == before).head()["rows"]
        failed = [told for told, bad in (("rows differ", seen["rows"] != rows), ("values are open", seen["open"] > 0), ("known values changed", seen["lost"] > 0)) if bad]
        if failed:
            return {"before": before, "after": None, "ok": False, "failed": failed, **seen}, self.snapshots.restore(name, before)
        written = points.sparkSession.read.schema(out.schema).parquet(stage)
        after = self.snapshots.create(written.filter("route <> 'rejected'").select(*points.columns), name)
        return {"before": before, "after": after, "ok": True, "failed": [], **seen}, self.snapshots.restore(name, after)
