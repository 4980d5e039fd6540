"""Tables of any size to look things up in while a task runs: sorted by hash, fetched by every executor once, memory-mapped.

The rows stay with the executors: they write the table in parts that are ranges of the
hash, the parts are registered as files of the job, and the first task of an executor
that needs them appends them to one file that all its tasks map.  Neither the driver
nor a Python worker holds the table.
"""

from __future__ import annotations

import fcntl
import os
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow.parquet as pq
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexquarry.storage import shared_dir

#: Rows of one part, about.
PART_ROWS = 4_000_000


@dataclass(frozen=True)
class Shipped:
    """A table ``(h, v)`` on its way: its name and the names of its parts, in the order of their hashes."""

    name: str
    parts: tuple[str, ...]
    texts: bool


def hashed(text: Column | str) -> Column:
    """The hash that ``hash_of`` computes in Python."""
    return F.xxhash64(text)


def hash_of(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 42)


def ship_table(rows: DataFrame, kind: str) -> Shipped:
    """Ship ``rows (h bigint, v)``, ``v`` a bigint, a string or bytes; several rows may have one hash.

    ``rows`` is read three times, so it should be cut from its lineage.
    """
    spark = rows.sparkSession
    name = f"{kind}-{uuid.uuid4().hex[:16]}"
    folder = f"{shared_dir(spark)}/side/{name}"
    n = max(1, -(-rows.count() // PART_ROWS))
    ranged = rows.select("h", "v").repartitionByRange(n, "h") if n > 1 else rows.select("h", "v").coalesce(1)
    ranged.sortWithinPartitions("h", "v").write.parquet(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = [str(f.getPath()) for f in path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path) if f.getPath().getName().startswith("part-")]
    for f in files:
        spark.sparkContext.addFile(f)
    return Shipped(name, tuple(sorted(f.rsplit("/", 1)[1] for f in files)), dict(rows.dtypes)["v"] != "bigint")


class Table:
    """A shipped table in a task."""

    def __init__(self, shipped: Shipped):
        base = os.path.join(SparkFiles.getRootDirectory(), shipped.name)
        with open(base + ".lock", "w") as lock:
            fcntl.flock(lock, fcntl.LOCK_EX)
            if not os.path.exists(base + ".done"):
                _append(shipped, base)
        load = lambda part, kind: np.memmap(base + part, kind, "r") if os.path.getsize(base + part) else np.empty(0, kind)
        self.h = load(".h", np.int64)
        self.v = load(".v", np.int64)
        self.texts = load(".t", np.uint8) if shipped.texts else None

    def first(self, keys: Iterable[str], missing: int = 0) -> list[int]:
        """The value of each key, ``missing`` where there is none."""
        keys = list(keys)
        h = np.fromiter(map(hash_of, keys), np.uint64, len(keys)).view(np.int64)
        if not len(self.h):
            return [missing] * len(keys)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return np.where(self.h[at] == h, self.v[at], missing).tolist()

    def span(self, h: int) -> tuple[int, int]:
        """The rows of one (signed) hash, from and to."""
        return int(np.searchsorted(self.h, h)), int(np.searchsorted(self.h, h, "right"))

    def data(self, row: int) -> bytes:
        """The bytes of a row; ``v`` holds where they end."""
        return self.texts[int(self.v[row - 1]) if row else 0 : int(self.v[row])].tobytes()

    def text(self, row: int) -> str:
        return self.data(row).decode("utf-8", "surrogatepass")


def _append(shipped: Shipped, base: str) -> None:
    end = 0
    with open(base + ".h", "wb") as hs, open(base + ".v", "wb") as vs, open(base + ".t", "wb") as ts:
        for batch in (b for p in _ordered(shipped) for b in pq.ParquetFile(p).iter_batches(columns=["h", "v"])):
            hs.write(batch.column(0).to_numpy().tobytes())
            if not shipped.texts:
                vs.write(batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64).tobytes())
                continue
            texts = [t if isinstance(t, bytes) else t.encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            ends = end + np.cumsum([len(t) for t in texts], dtype=np.int64)
            end = int(ends[-1]) if len(ends) else end
            vs.write(ends.tobytes())
            ts.write(b"".join(texts))
    open(base + ".done", "w").close()


def _ordered(shipped: Shipped) -> Sequence[str]:
    """The parts by their first hash; empty ones left out."""
    paths = [SparkFiles.get(p) for p in shipped.parts]
    firsts = [(next(pq.ParquetFile(p).iter_batches(1, columns=["h"])).column(0)[0].as_py(), p) for p in paths if pq.ParquetFile(p).metadata.num_rows]
    return [p for _, p in sorted(firsts)]
