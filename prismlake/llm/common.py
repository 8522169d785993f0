"""Helpers shared by the text operators: shared scratch tables, Arrow batch limits, filters, skewed joins, word hashing."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_scratch: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """A folder of this application below the cluster's spark.checkpoint.dir, or its context's checkpoint folder.

    Without either a local session takes a temporary folder; on a cluster that is an error, as a folder of one
    machine is not seen by the others. The folder is removed when the Python driver ends.
    """
    context = spark.sparkContext
    if context.applicationId not in _scratch:
        shared = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
        if not shared:
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            shared = "file://" + tempfile.mkdtemp(prefix="prismlake-")
        _scratch[context.applicationId] = f"{shared.rstrip('/')}/prismlake-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _scratch[context.applicationId])
    return _scratch[context.applicationId]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the JVM may be gone by now
        pass


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, rows: int = 2000, mb: int = 8) -> None:
    """Limit what one Arrow batch hands to a Python worker, so that long texts don't add up.

    The limits are the session's from then on: plans run after the operator has returned, so they can't be taken back.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict | None], schema: str) -> DataFrame:
    """mapInArrow with a function from one batch to a dict of columns (None: no rows)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema), prefers_large_types=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if out is not None:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[f.name], type=f.type, from_pandas=False) for f in target], schema=target
                )
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Hand what a task has freed back to the system: its worker lives on and will serve other operators."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


#: Rows of one key from which on it is hot, and the most hot keys that are broadcast.
HOT, MOST_HOT = 2_000, 10_000


def join_counted(rows: DataFrame, counted: DataFrame, keys: list[str], how: str = "inner", small: str = "true") -> DataFrame:
    """rows joined (inner or left) with counted: a table with one row for each key, and in `many` how many rows have it.

    Hot keys' rows stay where they are and get their key's row by broadcast; the others are shuffled. A key is hot
    with more than HOT rows and more than one in MOST_HOT of all, so at most MOST_HOT rows are broadcast; `small`
    is a condition on counted that bounds such a row's size, for those with arrays.
    """
    total, most = counted.agg(F.sum("many"), F.max("many")).first()
    limit = max(HOT, (total or 0) // MOST_HOT)
    if (most or 0) <= limit:
        return rows.join(counted, keys, how)
    is_hot = (F.col("many") > limit) & F.expr(small)
    hot = counted.where(is_hot)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(counted.where(~is_hot), keys, how)
    return rows.join(F.broadcast(hot), keys).unionByName(rest)


#: Bits of the largest Bloom filter (32 MB) and hashes of an id.
BLOOM_BITS, BLOOM_HASHES = 1 << 28, 4


class Bloom:
    """Which rows may have one of some ids, decided before a join with the ids shuffles all rows.

    The filter has 16 bits for each id and at most BLOOM_BITS; beyond that it lets more pass, never less.
    """

    def __init__(self, ids: DataFrame):
        spark = ids.sparkSession
        ids = ids.select(ids[ids.columns[0]].alias("id"))
        count = ids.agg(F.approx_count_distinct("id")).first()[0]
        self.bits = min(BLOOM_BITS, 1 << max(10, (16 * count).bit_length()))
        places = ids.select(F.explode(F.array(*self._places("id"))).alias("p"))
        words = places.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("b"))
        found = words.toArrow()  # at most bits / 64 numbers
        table = np.zeros(self.bits // 64, np.int64)
        table[found.column("w").to_numpy()] = found.column("b").to_numpy()
        self.sent = spark.sparkContext.broadcast(table)

    def _places(self, c: str) -> list:
        return [F.pmod(F.xxhash64(F.lit(i), c), F.lit(self.bits)) for i in range(BLOOM_HASHES)]

    def asked(self, rows: DataFrame, key: str) -> DataFrame:
        """The rows with the columns that test() needs."""
        return rows.select("*", *(p.alias(f"_p{i}") for i, p in enumerate(self._places(key))))

    def test(self, batch: pa.RecordBatch) -> np.ndarray:
        """Which rows of a batch may have one of the ids."""
        may = np.ones(batch.num_rows, bool)
        for i in range(BLOOM_HASHES):
            p = batch.column(f"_p{i}").to_numpy()
            may &= (self.sent.value[p >> 6] >> (p & 63) & 1).astype(bool)
        return may

    def rows(self, rows: DataFrame, key: str, hit: bool = True) -> DataFrame:
        """The rows that may have one of the ids, or those that have none."""
        columns = rows.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(self.test(batch) == hit)).select(columns)

        return self.asked(rows, key).mapInArrow(run, rows.schema)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def text_bytes(value: str | None) -> bytes:
    return b"" if value is None else value.encode("utf-8", "surrogatepass")
