"""Shared plumbing of the corpus operators: scratch tables, reading, size-checked broadcasts."""

from __future__ import annotations

import atexit
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word: a maximal run of characters other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"

#: Largest table, in estimated bytes, that may be broadcast.
BROADCAST_BYTES = 8 << 20

#: How to drop what an operator's tasks remember in a worker, by operator.
forget: dict[str, object] = {}

_written: list[tuple[SparkSession, str]] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. One of our own only where none is named and all runs on this machine, as in tests."""
    set_dir = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not set_dir and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
    return set_dir or "file:///tmp/checkpoints/larkspur"


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_dir(spark)}/larkspur/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared scratch folder and read it back: lineage is cut and the rows survive lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def discard(*tables: DataFrame) -> None:
    """Delete what ``materialize`` wrote for these tables, once what is made of them has been written."""
    for df in tables:
        at = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
        for item in [x for x in _written if any(a.endswith(x[1].split(":")[-1].lstrip("/")) for a in at)]:
            _delete(*item)
            _written.remove(item)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the JVM has gone; the folder's owner cleans it
            return


def fresh(columns: list[str], name: str) -> str:
    """The name, with as many underscores added as part it from the columns given."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


#: A key is hot if it holds more than one row in so many. There are fewer such keys than this.
HOT_SHARE = 4096


def spread_join(big: DataFrame, small: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Inner join on ``key``, a key of small's once only. small.count: rows that big has of the key, of ``total`` in all.

    Rows of hot keys meet a broadcast, which holds fewer than HOT_SHARE rows whatever the input, so that no key is one task's.
    """
    hot = small.where(F.col(count) * HOT_SHARE > total).drop(count)
    rest = small.where(F.col(count) * HOT_SHARE <= total).drop(count)
    of_hot = big.join(F.broadcast(hot), key)
    of_rest = big.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key)
    return of_hot.unionByName(of_rest)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def broadcast_if_small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """A broadcast hint only where the counted rows prove the table small; otherwise the join shuffles."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def crc_mod(id_col: str, mod: int):
    """crc32 of the id's decimal text, modulo mod; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % mod


#: Bytes of an Arrow batch that the operators' tasks are handed: long texts come fewer at a time.
BATCH_BYTES = 8 << 20

_last_owner = ""


def small_batches(spark: SparkSession) -> None:
    """Have the session cut Arrow batches at BATCH_BYTES, unless it cuts them finer."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).lower().rstrip("b")
    unit = {"k": 10, "m": 20, "g": 30}.get(now[-1:], 0)
    held = int(now.rstrip("kmg") or 0) << unit
    if not 0 < held <= BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")


def alone(owner: str) -> None:
    """At the start of a task: drop what other operators remember in this worker, so that one cache is held at a time.

    Where the operator has changed, memory that was freed goes back to the machine too.
    """
    global _last_owner
    if owner == _last_owner:
        return
    _last_owner = owner
    for name, drop in forget.items():
        if name != owner:
            drop()
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def append_scores(docs: DataFrame, text_col: str, owner: str, score, threshold: float, only: bool = False) -> DataFrame:
    """docs with score (double) and predicted (int) added, under names with underscores added where docs has them.

    score: an array from a list of texts. only: the rows predicted 1 alone, with the columns given and no more.
    """
    small_batches(docs.sparkSession)
    names, at = docs.columns, docs.columns.index(text_col)
    new = [fresh(names, "score"), fresh(names, "predicted")]
    schema = docs.schema if only else T.StructType([*docs.schema.fields, T.StructField(new[0], T.DoubleType()), T.StructField(new[1], T.IntegerType())])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        alone(owner)
        for b in batches:
            if not b.num_rows:
                continue
            s = np.concatenate([score([t or "" for t in b.column(at).slice(i, 256).to_pylist()]) for i in range(0, b.num_rows, 256)])
            if only:
                yield b.filter(pa.array(s >= threshold))
            else:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], [*names, *new])

    return docs.mapInArrow(run, schema)
