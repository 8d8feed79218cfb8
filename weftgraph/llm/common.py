"""Session helpers shared by the operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as tk


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir); a local one only in local mode, where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "/tmp/checkpoints/weftgraph"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Paths of tables by the calls of ``settled`` that are under way.
_MADE: list[list[str]] = []


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read again: cuts
    lineage, and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weft-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for made in _MADE:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def discard(*tables: DataFrame | None) -> None:
    """Removes tables made by ``stored`` that nothing will read again."""
    for df in tables:
        for path in {f.rpartition("/")[0] for f in df.inputFiles()} if df is not None else ():
            if "/weft-" in path:
                _remove(df.sparkSession, path)


def settled(spark: SparkSession, make: Callable[[], DataFrame], label: str) -> DataFrame:
    """``make()``, stored; all the other tables stored on the way are removed."""
    made: list[str] = []
    _MADE.append(made)
    try:
        out = stored(make(), label)
        for path in made[:-1]:  # those already discarded do no harm
            _remove(spark, path)
    finally:
        _MADE.pop()
    return out


def with_fields(df: DataFrame, *fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, t in fields)])


def text_size(df: DataFrame, text_col: str = "text") -> int:
    return df.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(id_col: str, m: int):
    """crc32 of the id written as text, modulo ``m``."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(m))


#: Bits of an id bitmap (2 MB): a fixed size, which filters less the more ids there are.
BITMAP = 1 << 24


def id_bitmap(ids: DataFrame, col: str) -> np.ndarray:
    """A bitmap of hashed ids, to tell most other rows apart without a shuffle."""
    h = ids.select(F.pmod(F.xxhash64(col), F.lit(BITMAP)).alias("h"))
    words = h.groupBy(F.shiftright("h", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(h & 63 AS INT))")).alias("b")).collect()
    out = np.zeros(BITMAP >> 6, np.uint64)
    for w, b in words:  # BITMAP / 64 at most
        out[w] = np.uint64(b & (2**64 - 1))
    return out


def by_bitmap(df: DataFrame, col: str, bits: np.ndarray, inside: bool) -> DataFrame:
    """Rows whose id may be in the bitmap, or those whose id surely isn't."""
    sent = df.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        for batch in batches:
            h = np.asarray(batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False), np.int64)
            hit = (sent.value[h >> 6] >> (h & 63).astype(np.uint64)) & np.uint64(1) == 1
            yield pa.RecordBatch.from_arrays(batch.columns[:-1], names=batch.schema.names[:-1]).filter(pa.array(hit if inside else ~hit))

    # the hash comes last, whatever the names of the columns
    return df.select("*", F.pmod(F.xxhash64(col), F.lit(BITMAP)).alias("_weft_bit")).mapInArrow(tk.handing_back(run), df.schema)
