"""Session helpers: local sessions for tests and benches, and this package on the executors."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent
_sent: set[str] = set()


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A session on this machine with the settings the plans are made for."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("scenewright")
    settings = {
        "spark.driver.memory": memory,
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    } | conf
    session = builder.config(map=settings).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def scratch(spark: SparkSession, kind: str) -> str:
    """A new folder that all executors share: below ``spark.checkpoint.dir``, or a temporary one in local mode; deleted when the driver's Python ends."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="files-")
    path = f"{at.rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    if path.startswith("/"):
        path = "file://" + path
    atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone; the folder's owner cleans up then
        pass


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    folder = tempfile.mkdtemp(prefix="ship-")
    at = os.path.join(folder, f"{_ROOT.name}.zip")
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(_ROOT.rglob("*.py")):
            z.write(path, path.relative_to(_ROOT.parent))
    spark.sparkContext.addPyFile(at)
    _sent.add(app)
