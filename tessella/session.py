"""Spark session factory with the settings that the engine relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "tessella", master: str | None = None, shuffle_partitions: int | None = None,
                  **conf: str) -> SparkSession:
    """Return a session: adaptive execution on, UTC, ANSI casts. `master` None leaves the choice to spark-submit."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if master and master.startswith("local"):
        settings.setdefault("spark.driver.memory", os.environ.get("TESSELLA_DRIVER_MEMORY", "8g"))
        settings.setdefault("spark.driver.host", "127.0.0.1")
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()
