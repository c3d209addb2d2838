"""Helpers that several corpus operators share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; sf_dir can be any path that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where the setting is absent, a temporary folder serves on a local master only; a
    cluster without the setting is an error, as executors could not read each other's files.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master.startswith("local[") or master == "local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = os.path.join(tempfile.gettempdir(), f"quotelens-{os.getpid()}")
    return f"file://{own}"


#: Folders of the scopes that are open, the innermost last; the first takes what is cut outside of all.
_open: list[list[tuple]] = [[]]


def cut(df: DataFrame, stays: bool = False, frees: bool = False) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends there, so that a lost
    executor costs a read and not a recomputation. What drop() or a scope has not deleted by the
    end of the driver's process is deleted then; with stays, the innermost scope leaves it alone.
    With frees, the driver collects its garbage, so that Spark deletes the shuffle files of what is written
    by now; else they stay on the executors' disks until that happens by chance."""
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path  # for drop()
    if frees:
        gc.collect()
        df.sparkSession.sparkContext._jvm.System.gc()
    if not any(_open):
        atexit.register(_sweep)
    _open[max(-len(_open), -2 if stays else -1)].append((df.sparkSession, path))
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def drop(*frames: DataFrame) -> None:
    """Delete what cut() wrote, when nothing reads it any more."""
    for df in frames:
        path = getattr(df, "_cut_path", None)
        if path:
            _delete(df.sparkSession, path)
            for made in _open:
                made[:] = [x for x in made if x[1] != path]


def _sweep() -> None:
    for spark, path in [x for made in _open for x in made]:
        with contextlib.suppress(Exception):  # the session may have ended
            _delete(spark, path)
    _open[:] = [[]]


@contextlib.contextmanager
def scope():
    """What is cut inside is deleted at the end: for steps whose result has been written by then."""
    _open.append([])
    try:
        yield
    finally:
        for spark, path in _open.pop():
            _delete(spark, path)


def give_back() -> None:
    """Return freed memory to the system: workers are used again by later stages, and what their
    allocators keep would count in all of them."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(run):
    """run(), a function of Arrow batches, with give_back() after its last batch."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


#: Bytes and rows of an Arrow batch: whole texts travel in them, so rows alone are no bound.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 4096


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session, unless its own bounds are lower."""
    for key, most in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)):
        now = str(spark.conf.get(key)).rstrip("bB")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def quoted(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, name: str) -> str:
    """A name like `name` that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)


def mix64(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3, over an array."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> _S)
        x = x * _M1
        x = x ^ (x >> _S)
        x = x * _M2
        return x ^ (x >> _S)


def least_errors(values: np.ndarray, labels: np.ndarray, wrong_no: float, wrong_yes: float) -> float:
    """The threshold with the least cost when values at or above it mean yes: wrong_no for a label
    1 below it, wrong_yes for a label 0 above it. It lies in the middle of its gap."""
    order = np.argsort(values, kind="stable")
    v, t = values[order], labels[order]
    cost = wrong_no * np.concatenate([[0], np.cumsum(t)]) + wrong_yes * ((1 - t).sum() - np.concatenate([[0], np.cumsum(1 - t)]))
    same = np.concatenate([[False], v[1:] == v[:-1], [False]])  # equal values stay together
    k = int(np.argmin(np.where(same, np.inf, cost)))
    low = v[k - 1] if k else v[0] - 1
    high = v[k] if k < len(v) else v[-1] + 1
    return float((low + high) / 2)


#: A-Z to a-z and nothing else.
LOWER_AZ = {i: i + 32 for i in range(65, 91)}


def lower_az(text: str) -> str:
    """Lower-case A-Z only."""
    return text.lower() if text.isascii() else text.translate(LOWER_AZ)


def map_texts(df: DataFrame, make, fields: str, keep: list[str], column: str = "text") -> DataFrame:
    """df's columns `keep` with new ones that Python makes from one column, batch by batch.

    make() is called once in each task and returns a function from a list of values to a list of
    lists, one for each of `fields` (a DDL string). The kept columns pass through as Arrow arrays,
    so nulls and large integers stay as they are; a column that is kept and read travels once.
    Batches are cut to MAX_CHARS of text, so that very long documents do not meet in one batch's
    Python objects. The new fields must not be called like kept ones; fresh() finds names.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    small_batches(df.sparkSession)
    carried = keep if column in keep else [*keep, column]
    source = df.select(*map(quoted, carried))
    at_text, kept = carried.index(column), len(keep)
    new = StructType.fromDDL(fields)
    schema = StructType([*source.schema.fields[:kept], *new.fields])
    names = [f.name for f in schema.fields]
    kinds = [to_arrow_type(f.dataType) for f in schema.fields]

    def run(batches):
        f = make()
        for batch in batches:
            for at, n in _pieces(batch.column(at_text), MAX_CHARS):
                part = batch.slice(at, n)
                old = [part.column(i).cast(kinds[i]) for i in range(kept)]
                made = f(part.column(at_text).to_pylist())
                arrays = [x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(made, kinds[kept:])]
                yield pa.RecordBatch.from_arrays(old + arrays, names=names)

    return source.mapInArrow(tidy(run), schema)


#: Bytes of text that Python handles at once, unless one text alone has more.
MAX_CHARS = 1_000_000


def _pieces(values, most: int):
    """(offset, length) of runs of rows with about `most` bytes."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
    at, total = 0, 0
    for i, x in enumerate(sizes):
        if i > at and total + x > most:
            yield at, i - at
            at, total = i, 0
        total += int(x)
    if len(sizes) > at:
        yield at, len(sizes) - at
