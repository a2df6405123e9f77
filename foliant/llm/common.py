"""What the operators of this subpackage share: shared storage, checkpoints, Arrow mapping, components."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.session import checkpoint, shared_dir

#: Bits of the filter that tells which terms may be looked up; its size doesn't depend on the corpus.
BITS = 1 << 23


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


class Sent:
    """A broadcast under a name of its own, by which workers know what they have made of it."""

    def __init__(self, spark: SparkSession, value):
        self.key, self.broadcast = uuid.uuid4().hex, spark.sparkContext.broadcast(value)

    @property
    def value(self):
        return self.broadcast.value


_held: dict = {}


def held(key, make: Callable[[], object]):
    """What ``make`` gives, kept in this Python worker until another key is asked for: a worker that goes from stage to
    stage holds one model and its caches at a time."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


class Lookup:
    """Whole numbers to values, for many at once: tables by different hashes, each for what the ones before have no place for."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.tables = []
        keys, values = keys.astype(np.uint64), values.astype(np.int32)
        while len(keys):
            bits = max(4, int(len(keys) * 8).bit_length())
            mult, shift = np.uint64(0x9E3779B97F4A7C15 + 2 * 0x51ED2701 * len(self.tables)), np.uint64(64 - bits)
            at = (keys * mult) >> shift
            own, to = np.full(1 << bits, ~np.uint64(0)), np.full(1 << bits, -1, np.int32)
            own[at], to[at] = keys, values
            self.tables.append((mult, shift, own, to))
            rest = own[at] != keys
            keys, values = keys[rest], values[rest]

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Each key's value, -1 if it has none."""
        keys = keys.astype(np.uint64)
        out = np.full(keys.shape, -1, np.int32)
        for mult, shift, own, to in self.tables:
            at = ((keys * mult) >> shift).astype(np.intp)
            out = np.where(own[at] == keys, to[at], out)
        return out


def map_arrow(df: DataFrame, each: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: T.StructType | str, rows: int = 512) -> DataFrame:
    """``each`` on slices of at most ``rows`` rows, so that the memory a Python worker needs stays bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = each(batch.slice(at, rows))
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def filter_bits(terms: DataFrame) -> np.ndarray:
    """A bit for the crc32 of each term: BITS / 64 numbers at most, whatever the number of terms."""
    at = F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(BITS))
    rows = terms.select(F.shiftright(at, 6).cast("int").alias("at"), F.expr("shiftleft(1L, cast(crc32(cast(term as binary)) % 64 as int))").alias("bit"))
    bits = np.zeros(BITS // 64, np.int64)
    found = rows.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits[found.column("at").to_numpy()] = found.column("bits").to_numpy()
    return bits


def maybe_in(bits: bytes, term: str) -> bool:
    """Whether the term may be one of those that the filter was made of."""
    h = zlib.crc32(term.encode("utf-8", "surrogatepass")) % BITS
    return bits[h >> 3] >> (h & 7) & 1


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of the undirected edges (u, v): component is the smallest node reached.

    Alternates large-star and small-star steps until the edges are stars around each component's
    smallest node; every round is a few aggregations and equi-joins (skewed ones are split by AQE),
    kept in the shared folder. No edge reaches the driver. Nodes without edges aren't returned.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    e = checkpoint(e)
    state = None
    while True:
        sym = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = checkpoint(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        got = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if got == state or not got[0]:
            break
        state = got
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
