"""Session settings and the shared work folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def prepare_session(spark: SparkSession) -> SparkSession:
    """Session settings the operators count on.

    Times are UTC, a repeated JSON key takes its last value, and skewed joins are split.
    """
    for name, value in (
        ("spark.sql.session.timeZone", "UTC"),
        ("spark.sql.variant.allowDuplicateKeys", "true"),
        ("spark.sql.adaptive.enabled", "true"),
        ("spark.sql.adaptive.skewJoin.enabled", "true"),
    ):
        spark.conf.set(name, value)
    return spark


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for checkpoints and intermediate tables.

    It lies in the shared folder named by ``spark.checkpoint.dir``.  Only where that is
    unset, and driver and executors are one process, is it a folder of this machine.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.gettempdir() + "/pagetables"
    return f"{shared.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
