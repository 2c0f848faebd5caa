"""Shared helpers: scratch tables that outlive executors, Arrow batches as bytes, input columns."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of all text contracts: space, tab, LF, VT, FF, CR.
BLANK = r"[\x20\x09-\x0D]"

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary one only in local mode."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _own:
        _own["dir"] = "file://" + tempfile.mkdtemp(prefix="scratch-")
    return _own["dir"]


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder, deleted when the driver's Python ends."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone; the folder's owner cleans up then
        pass


class Cut:
    """Written tables that cut the lineage; a lost executor costs nothing that was written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def __call__(self, df: DataFrame, kind: str = "table") -> DataFrame:
        path = scratch_path(self.spark, kind)
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(back)] = (back, path)
        return back

    def free(self, df: DataFrame) -> None:
        """Delete a table that no later plan reads."""
        if kept := self.paths.pop(id(df), None):
            _delete(self.spark, kept[1])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(df: DataFrame, growth: float = 1.0, bytes_: int = 128 << 20) -> int:
    """Shuffle partitions for a table that is ``growth`` times ``df``: those that the session sets, or more where they would get over ``bytes_``.

    The size of ``df`` is the optimiser's, read from file sizes; without one the session's setting stands.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(least, min(int(size * growth / bytes_) + 1, 1 << 16)) if size < 1 << 60 else least


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n+1 offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def small(batches: Iterator[pa.RecordBatch], size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``size`` bytes, so that what is made of one at a time stays small; a longer text is alone."""
    for batch in batches:
        rows = max(1, batch.num_rows * size // max(size, batch.nbytes))
        for k in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(k, rows)


def as_bytes(column: pa.Array) -> list[bytes]:
    """Each text of a string column in UTF-8; null is empty."""
    raw, at = buffers(column)
    whole = raw.tobytes()
    return [whole[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def pick(docs: DataFrame, **columns: str) -> DataFrame:
    """Only the named input columns, under the operator's own names: extra or clashing columns never matter."""
    return docs.select(*[F.col(f"`{name}`").alias(alias) for alias, name in columns.items()])


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores as keep it apart from all columns of ``docs``."""
    taken = {c.lower() for c in docs.columns}
    made = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        made.append(name)
    return made
