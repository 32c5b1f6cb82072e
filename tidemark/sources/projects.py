"""Projects: a small JSON file that says where a series lies and how it is read, resampled and forecast; one call that loads it.

Files are read and written through Spark, so that a project may lie wherever Spark's tables do.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.stats import INTERVAL_Z
from tidemark.operators import design
from tidemark.operators.prepare import dominant_step, resample
from tidemark.sources.merkle import _summed
from tidemark.sources.tables import indexed, read_series_csv

#: What a project may require.
VERSION = "0.3.0"
SUFFIX = ".forecast.json"
# fixed values: keys of a project file and what holds where they are absent or null
DEFAULTS = {
    "name": None,
    "description": "",
    "data": None,
    "timeColumn": None,
    "valueColumn": None,
    "unit": None,
    "seasonLength": None,
    "horizon": 24,
    "interval": 80,
    "testSize": None,
    "resample": False,
    "agg": "mean",
    "step": None,
    "damped": False,
    "seasonality": "additive",
    "methods": None,
    "features": None,
    "method": "auto",
}
WHOLE = ("seasonLength", "horizon", "interval", "testSize", "step")
FLAGS = ("resample", "damped")
AGGREGATES = ("mean", "sum", "first", "last", "min", "max")


@dataclass(frozen=True)
class Loaded:
    """A project's settings, its points (series_id, t, value, idx), rows left out (line, reason), and the digest of its text."""

    config: dict
    points: DataFrame
    skipped: DataFrame
    digest: str
    step_ms: int | None
    observed: DataFrame

    def findings(self) -> DataFrame:
        """``design.findings`` of the points, and of times that repeat in the rows as read; a season of 7 where the project has none."""
        return design.findings(self.points, self.config["seasonLength"] or 7, self.observed)


def _numbers(version: str) -> list[int]:
    found = re.fullmatch(r"\d+(\.\d+)*", version)
    if not found:
        raise ValueError(f"not a version: {version!r}")
    return [int(x) for x in version.split(".")]


def compare_versions(a: str, b: str) -> int:
    """-1, 0 or 1; parts that are absent count as 0."""
    x, y = _numbers(a), _numbers(b)
    width = max(len(x), len(y))
    x, y = x + [0] * (width - len(x)), y + [0] * (width - len(y))
    return (x > y) - (x < y)


def satisfies(version: str, wanted: str | None) -> bool:
    """Whether ``version`` is the one wanted; ``^2.1`` wants 2.1 or later of 2, nothing and ``*`` any, as does ``^`` of one part."""
    if not wanted or wanted == "*":
        return True
    if not wanted.startswith("^"):
        return version == wanted
    have, want = _numbers(version), _numbers(wanted[1:])
    return len(want) < 2 or (have[0] == want[0] and [*have, 0][1] >= want[1])


def default_project(name: str, data: str) -> dict:
    return DEFAULTS | {"name": name, "data": data, "requiresVersion": VERSION}


def write_project(spark: SparkSession, path: str, project: Mapping) -> None:
    """Writes ``project`` as one JSON file, over one that is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(json.dumps(dict(project), indent=2, ensure_ascii=False) + "\n", "utf-8"))
    finally:
        out.close()


def _split(path: str) -> tuple[str, str]:
    folder, _, name = path.rpartition("/")
    return (folder or ("/" if path.startswith("/") else ".")), name


def read_project(spark: SparkSession, path: str, version: str = VERSION) -> tuple[dict, str]:
    """(project, its folder). ``path`` is a file, or a folder with exactly one file that ends in ``.forecast.json``."""
    if path.endswith(".json"):
        rows = spark.read.text(path, wholetext=True).take(1)
        folder = _split(path)[0]
    else:
        rows = spark.read.option("pathGlobFilter", f"*{SUFFIX}").text(path, wholetext=True).take(2)
        folder = path.rstrip("/") or "/"
        if len(rows) != 1:
            raise ValueError(f"{path} holds {'no project' if not rows else 'more than one project'}")
    try:
        project = json.loads(rows[0]["value"] if rows else "")
    except json.JSONDecodeError as e:
        raise ValueError(f"{path} is no JSON: {e}") from None
    if not isinstance(project, dict) or not project.get("data"):
        raise ValueError(f"{path} names no data")
    if not satisfies(version, project.get("requiresVersion")):
        raise ValueError(f"{path} requires version {project['requiresVersion']}; this is {version}")
    return project, folder


def settings(project: Mapping, options: Mapping) -> dict:
    """All settings: of the options, else of the project, else the defaults. Flags are on if either says so; unknown options raise."""
    if unknown := sorted(set(options) - set(DEFAULTS)):
        raise ValueError(f"no setting {unknown[0]}; there are {', '.join(DEFAULTS)}")
    out = {}
    for key, default in DEFAULTS.items():
        found = [m[key] for m in (options, project) if m.get(key) is not None]
        out[key] = any(x is True for x in found) if key in FLAGS else found[0] if found else default
    for key in WHOLE:
        if out[key] in (None, ""):
            out[key] = DEFAULTS[key]
            continue
        text = str(out[key]).strip()
        if isinstance(out[key], bool) or not re.fullmatch(r"\d+(\.0+)?", text):
            raise ValueError(f"{key} is a whole number from 0 on, not {out[key]!r}")
        out[key] = int(float(text)) if "." in text else int(text)
    if isinstance(out["methods"], str):
        out["methods"] = [m.strip() for m in out["methods"].split(",") if m.strip()]
    for key, among in (("seasonality", ("additive", "multiplicative")), ("interval", tuple(INTERVAL_Z)), ("agg", AGGREGATES)):
        if out[key] not in among:
            raise ValueError(f"{key} is one of {', '.join(map(str, among))}, not {out[key]!r}")
    if out["horizon"] < 1:
        raise ValueError("horizon is 1 or more")
    if out["step"] == 0:
        raise ValueError("step is 1 or more milliseconds")
    return out


def text_digest(spark: SparkSession, path: str) -> str:
    """A digest of the lines of a file or folder, each hashed where it is read; the order of lines and files doesn't count, repeats do."""
    return spark.read.text(path).agg(_summed(F.sha2("value", 256)).alias("digest")).head()["digest"]


def load(spark: SparkSession, project: str | None = None, **options) -> Loaded:
    """The series of a project file, or of ``data`` alone, read, resampled if wanted, and ready for checks.

    ``options`` are named as the keys of a project file and go before it; a relative ``data`` counts from the project's folder. Resampling
    takes ``step`` milliseconds, or the most common step, and one of the aggregates; bins without a point are absent. Rows with an empty
    value are left out and told, other bad rows raise."""
    held, folder = read_project(spark, project) if project else ({}, "")
    config = settings(held, options)
    if not config["data"]:
        raise ValueError("no data: name a project file or data")
    apart = "://" in config["data"] or config["data"].startswith(("/", "file:"))
    path = config["data"] if apart or not folder else f"{folder.rstrip('/')}/{config['data']}"
    points, skipped = read_series_csv(spark, path, config["timeColumn"], config["valueColumn"])
    observed, step = points.select("series_id", "t"), None
    points = points.select("series_id", "t", "value", "idx")
    if config["resample"]:
        found = dominant_step(points).head() if config["step"] is None else None
        step = config["step"] or (found["step_ms"] if found else None)
        if step is not None:
            start = points.agg(F.unix_millis(F.min("t"))).head()[0]
            points = indexed(resample(points, step).select("series_id", F.timestamp_millis(F.lit(start) + F.col("bin") * step).alias("t"), F.col(config["agg"]).alias("value")))
    config["name"] = config["name"] or _split(path.rstrip("/"))[1]
    return Loaded(config, points, skipped, text_digest(spark, path), step, observed)
