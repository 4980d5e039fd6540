"""Shared storage: where lineage is cut and where small side files are kept.

Everything goes to the folder named by ``spark.checkpoint.dir``, which all
executors share.  Only where that setting is absent and Spark runs in one process
(tests) a temporary folder is made, which goes with the process; on a cluster the
setting is needed.  Checkpoints that nothing refers to any more are removed by Spark if
``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
"""

from __future__ import annotations

import atexit
import hashlib
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

_fallback: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session; sets it on the context where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    app, master = spark.sparkContext.applicationId, spark.sparkContext.master
    if not re.fullmatch(r"local(?:\[.*\])?", master):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
    if app not in _fallback:
        folder = tempfile.mkdtemp(prefix="lexquarry-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _fallback[app] = "file://" + folder
    return _fallback[app]


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=eager)


def ship(spark: SparkSession, payload: bytes, kind: str) -> str:
    """Put ``payload`` into the shared folder and hand it to all executors as a file.

    Returns the name under which ``SparkFiles.get`` finds it.  The name is made
    from the content, so the same payload is shipped once.
    """
    name = f"{kind}-{hashlib.sha256(payload).hexdigest()[:24]}.bin"
    jvm, context = spark._jvm, spark.sparkContext
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/side/{name}")
    fs = path.getFileSystem(context._jsc.hadoopConfiguration())
    if not fs.exists(path):
        out = fs.create(path, True)
        try:
            for at in range(0, len(payload), 1 << 20):
                out.write(bytearray(payload[at : at + (1 << 20)]))
        finally:
            out.close()
    context.addFile(path.toString())
    return name


_shuffled = re.compile(r"(?m)^[ :+-]*(?:Join|Aggregate|Window|Distinct|Repartition\w*|Sort|Deduplicate|GlobalLimit|Intersect|Except)\b")


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` of a scan over at least as many tasks as there are cores.

    Input in fewer splits than cores (a small file of one row group) is dealt out by
    one shuffle; larger input, which has more splits than that, is left as it is.  So are
    rows that come out of a shuffle: their tasks are counted when they run.
    """
    if _shuffled.search(rows._jdf.queryExecution().optimizedPlan().toString()):
        return rows
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def tasks(spark: SparkSession, rows: int, per: int) -> int:
    """Into how many tasks ``rows`` are dealt for work in Python: some rounds of all cores, more where a task would have over ``per`` rows.

    A shuffle by a fixed number is not coalesced, as one by size would be, which sees the bytes and not the work.
    """
    return max(2 * spark.sparkContext.defaultParallelism, -(-rows // per))
