"""Shared pieces: the shared scratch folder, shipping the package, 64-bit hashing of words."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from fathom.session import shared_folder

#: White space of the contracts: \x20 and \x09-\x0D, which is also what bytes.split() splits at.
SPACE = b" \t\n\x0b\x0c\r"
#: A-Z to a-z on UTF-8 bytes; everything else stays.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

_shipped: set[str] = set()


#: Rows of a batch that Python tasks get, unless the session sets a number of its own: whole texts are long, and a batch is held several times over.
BATCH, _ROWS = "1000", "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that workers can import it anywhere, and lower the size of Arrow batches from its default."""
    if spark.conf.get(_ROWS) == "10000":
        spark.conf.set(_ROWS, BATCH)
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root = Path(__file__).resolve().parents[1]
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    path = os.path.join(tempfile.mkdtemp(), "fathom_package.zip")
    Path(path).write_bytes(held.getvalue())
    sc.addPyFile(path)


def settle(df: DataFrame) -> DataFrame:
    """Write df to the shared folder as Parquet and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    held = spark.read.schema(df.schema).parquet(path)
    held._settled = path
    if _open:
        _open[-1].append(held)
    return held


_open: list[list[DataFrame]] = []


@contextmanager
def passing() -> Iterator[list[DataFrame]]:
    """Tables that are settled inside go at the end, but for those that are taken out of the list: what leaves must not read the others."""
    held: list[DataFrame] = []
    _open.append(held)
    try:
        yield held
    finally:
        _open.pop()
    for table in held:
        discard(table)


def discard(df: DataFrame) -> None:
    """Delete a settled table that nothing will read any more."""
    jvm = df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(df._settled)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores in front until no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_rng = np.random.Generator(np.random.PCG64(20240501))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = int(_rng.integers(2**62, 2**63)) | 1
_INVERSE = pow(_BASE, -1, 2**64)
_power = np.ones(1, np.uint64)
_unpower = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base, and of its inverse, modulo 2**64."""
    global _power, _unpower
    if len(_power) < n:
        grown = max(n, 1 << 16)
        for name, base in (("_power", _BASE), ("_unpower", _INVERSE)):
            table = np.full(grown, base, np.uint64)
            table[0] = 1
            globals()[name] = np.multiply.accumulate(table)
    return _power, _unpower


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer on uint64 (multiply and shift rounds)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(joined: bytes, words: int) -> np.ndarray:
    """Hashes of every run of `words` words in `joined`, words that are each followed by one space.

    With fewer words, the hash of the whole sequence. Rolling polynomial over
    bytes: a span's hash doesn't depend on its place.
    """
    raw = np.frombuffer(joined, np.uint8)
    ends = np.flatnonzero(raw == 32)
    power, unpower = _powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * power[: len(raw)], out=total[1:])
    starts = np.empty_like(ends)
    starts[0] = 0
    starts[1:] = ends[:-1] + 1
    k = min(words, len(ends))
    lo, hi = starts[: len(ends) - k + 1], ends[k - 1 :]
    return mix((total[hi] - total[lo]) * unpower[lo])
