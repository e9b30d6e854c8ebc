"""Session settings and lineage cuts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators rely on. Shuffle width and memory stay the cluster's."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut lineage through the shared checkpoint folder, so that lost executors do not restart the work.

    The folder is the one the session names in ``spark.checkpoint.dir``; see ``shared_folder``.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=eager)


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, set from ``spark.checkpoint.dir``.

    Where none is named, a local master (tests) gets a fresh local folder; a cluster raises, as its executors would not
    see one another's files.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local($|\[)", sc.master):
            raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemark-"))
    return sc.getCheckpointDir()


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
