"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from specloom.session import checkpoint_dir, prepare

#: Bytes of rows that may be broadcast, as estimated from all of them; beyond it, both sides are shuffled.
BROADCAST_BYTES = 32 << 20
#: Powers of two of the bits of a key filter, at least and at most (32 MB). It has 8 bits a key or more up to 32 million
#: keys; with more, it lets more of the other rows pass, and the join after it does the rest.
FILTER_BITS = (12, 28)
#: Bytes of text that go to a Python worker at once.
BATCH_BYTES = 8 << 20


def ready(df: DataFrame) -> SparkSession:
    """The session of ``df``, with a folder for checkpoints.

    Where the session has Spark's default of 64 MB for Arrow batches, they are made ``BATCH_BYTES``, as Python workers
    hold several at once; any other value stays.
    """
    spark = prepare(df.sparkSession)
    checkpoint_dir(spark)
    batches = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(batches) == "67108864b":
        spark.conf.set(batches, f"{BATCH_BYTES}b")
    return spark


def scratch(spark: SparkSession) -> str:
    """A new name for a table among the checkpoints, in the folder that all executors share; what is left there goes at the session's end."""
    return f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"


def discard(spark: SparkSession, folder: str) -> None:
    """Delete a table that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; a missing one is NULL. Columns of other names can't clash later."""
    kinds = {"doc_id": "bigint", "quality": "int", "n_chars": "bigint", "item_id": "bigint", "page_id": "bigint"}
    have = set(df.columns)
    return df.select(*[(F.col(f"`{n}`") if n in have else F.lit(None)).cast(kinds.get(n, "string")).alias(n) for n in names])


def _bytes(kind: T.DataType, c: F.Column) -> F.Column:
    """About the bytes that a value takes in a row."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.octet_length(c) + 16
    if isinstance(kind, T.ArrayType):
        inner = kind.elementType
        if isinstance(inner, (T.StringType, T.BinaryType, T.StructType, T.ArrayType)):
            return F.aggregate(c, F.lit(24).cast("bigint"), lambda a, x: a + F.coalesce(_bytes(inner, x).cast("bigint"), F.lit(8)))
        return F.size(c) * 8 + 24
    if isinstance(kind, T.StructType):
        total = F.lit(16)
        for f in kind.fields:
            total = total + F.coalesce(_bytes(f.dataType, c[f.name]), F.lit(8))
        return total
    return F.lit(8)


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its rows take at most ``limit`` bytes, else as it is (Spark then shuffles).

    The bytes of all rows are added up, so ``df`` should be a checkpoint or cheap to make.
    """
    row = F.lit(16).cast("bigint")
    for f in df.schema.fields:
        row = row + F.coalesce(_bytes(f.dataType, F.col(f"`{f.name}`")).cast("bigint"), F.lit(8))
    taken = df.select(F.sum(row)).head()[0] or 0
    return F.broadcast(df) if taken <= limit else df


def struct_type(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def _filter(keys: DataFrame) -> tuple[int, np.ndarray]:
    """Two bits for each row of ``keys`` in a table of a power of two of bits, and that power; ``keys`` should be a checkpoint."""
    low, high = FILTER_BITS
    bits = min(high, max(low, (8 * keys.count()).bit_length()))
    x = F.xxhash64(*keys.columns)
    at = keys.select(F.explode(F.array(F.shiftrightunsigned(x, 64 - bits), x.bitwiseAND((1 << bits) - 1))).alias("p"))
    words = at.groupBy(F.shiftright("p", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("m")).toArrow()  # at most 2 ** (bits - 6)
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[words["w"].to_numpy()] = words["m"].to_numpy().view(np.uint64)
    return bits, table


def among(keys: DataFrame) -> Callable[..., F.Column]:
    """A test of columns against the rows of ``keys``, of the same types: true for all that are among them and for few others.

    Two bits a key in a table that goes to all workers; it stands before a join so that rows without a partner aren't
    shuffled. ``keys`` should be a checkpoint.
    """
    bits, table = _filter(keys)

    @arrow_udf("boolean")
    def hit(x: pa.Array) -> pa.Array:
        h = x.to_numpy(zero_copy_only=False).view(np.uint64)
        ok = np.ones(len(h), bool)
        for p in (h >> np.uint64(64 - bits), h & np.uint64((1 << bits) - 1)):
            ok &= (table[p >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
        return pa.array(ok)

    return lambda *columns: hit(F.xxhash64(*columns))


def parted(df: DataFrame, keys: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """Rows of ``df`` whose columns are among the rows of ``keys``, of the same types, and few others; and the rest.

    The test of ``among`` without Python: its table is the one row of a broadcast, so that a stage with a Python kernel
    needs no second worker for each task, nor buffers for one.
    """
    bits, table = _filter(keys)
    name = f"__bits_{uuid.uuid4().hex}"
    row = F.broadcast(df.sparkSession.createDataFrame(pa.table({name: pa.ListArray.from_arrays(pa.array([0, len(table)], pa.int32()), pa.array(table.view(np.int64)))})))
    x = F.xxhash64(*columns)
    is_set = lambda p: F.getbit(F.get(name, F.shiftright(p, 6).cast("int")), p.bitwiseAND(63).cast("int")) == 1
    hit = is_set(F.shiftrightunsigned(x, 64 - bits)) & is_set(x.bitwiseAND((1 << bits) - 1))
    return df.join(row, hit, "left_semi"), df.join(row, hit, "left_anti")


def lacking(df: DataFrame, keys: DataFrame, *columns: str) -> DataFrame:
    """Rows of ``df`` whose columns (not NULL) are not among the rows of ``keys``; only those that may be are shuffled."""
    names = [f"__key_{uuid.uuid4().hex}" for _ in columns]
    keys = keys.toDF(*names)
    met, others = parted(df, keys, *columns)
    rest = met.join(keys, [met[c] == keys[k] for c, k in zip(columns, names)], "left_anti")
    return others.unionByName(rest)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``; at its end memory that is free goes back to the system, as idle Python workers keep it otherwise."""

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim:
                trim(0)

    return lean
