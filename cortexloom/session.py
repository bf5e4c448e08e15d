"""A Spark session set up for the engine."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import SparkSession

#: What the plans here count on: adaptive plans, split skewed joins, Arrow transfer, UTC, ANSI casts.
CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def session(app: str = "cortexloom", master: str | None = None, **conf: str) -> SparkSession:
    """The session on `master` (the submitter's if None), with CONF and then `conf`, dots in names as double underscores."""
    builder = SparkSession.builder.appName(app).config(map=CONF | {k.replace("__", "."): v for k, v in conf.items()})
    return (builder.master(master) if master else builder).getOrCreate()


def conf_from_json(path: str, out: str | None = None) -> dict[str, str]:
    """Spark settings of a JSON object (O-035), names and values as text; `out` + "_spark" is the local folder
    where the object names none."""
    with open(path, encoding="utf-8") as f:
        conf = json.load(f)
    if not isinstance(conf, dict) or any(isinstance(v, (dict, list)) for v in conf.values()):
        raise ValueError(f"{path}: an object of names and values")
    text = {k: json.dumps(v) if isinstance(v, bool) else str(v) for k, v in conf.items() if v is not None}
    if out is not None:
        text.setdefault("spark.local.dir", f"{out}_spark")
    return text


def session_from_json(path: str, app: str = "cortexloom", out: str | None = None, master: str | None = None) -> SparkSession:
    """A session with CONF and the settings of the file, which win."""
    builder = SparkSession.builder.appName(app).config(map=CONF | conf_from_json(path, out))
    return (builder.master(master) if master else builder).getOrCreate()


def scratch(spark: SparkSession, kind: str) -> str:
    """A new path in the folder that all executors share, spark.checkpoint.dir; a temporary one where that is
    unset and everything runs in this process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="cortexloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/cortexloom-{kind}-{uuid.uuid4().hex}"
