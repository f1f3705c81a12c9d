"""Session settings shared by the command line, the benchmark and the tests."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "gleanery", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow on.

    ``master`` and every setting stay those of the cluster if it names them;
    only a session started by itself gets a local master.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel(os.environ.get("GLEANERY_LOG", "ERROR"))
    return session
