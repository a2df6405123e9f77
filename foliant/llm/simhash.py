"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are 64-bit majorities over XXH64 hashes of word shingles. All distinct fingerprints are
compared exactly, tile against tile, by exclusive-or and bit counts. A tile holds fingerprints whose
64/parts-bit parts have the same population counts, so a pair of tiles whose counts differ by more than
the radius in sum can hold no link and is skipped. The more fingerprints, the finer the parts; tiles
that are still large are split, so that no task holds more than two of bounded size. A tile is packed into one row, once; rows
of tiles, not of fingerprints, are dealt to the pairs that they take part in, and there are as many tasks as there is to compare. A tile pair
yields a spanning forest of its links, never all pairs; copies of a text share a fingerprint and meet
no comparison at all. Components come from connected_components().

Null texts count as empty; a text without words has fingerprint zero and links like any other. Null
ids keep their rows; a component's id is its smallest non-null id (null if it has none). Repeated rows
and ties share a fingerprint and so a component. Only the id and text columns are read. An empty table gives an
empty one; a text of any length is taken whole, its hashes counted in runs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import checkpoint, connected_components, free_name, map_arrow, table

SEED = 42
#: Fingerprints in a tile, about, at most.
TILE = 1 << 16
#: Pairs of fingerprints compared at a time, and by a task, about.
BLOCK = 1 << 21
TASK = 1 << 32


def fingerprint_of(text: str | None, shingle: int = 3, seed: int = SEED) -> int:
    """The fingerprint as an unsigned number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line, size = b" ".join(words), min(shingle, len(words))
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])
    n = len(words) - size + 1
    digest = xxhash.xxh64_intdigest
    hashes = [digest(line[a:b], seed) for a, b in zip(starts[:n].tolist(), (ends[size - 1 :] - 1).tolist(), strict=True)]
    h = np.array(hashes, np.uint64).astype(">u8").view(np.uint8).reshape(n, 8)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        counts += np.unpackbits(h[at : at + 65536], axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n).view(">u8")[0])


def with_fingerprint(df: DataFrame, text_col: str = "text", out_col: str = "_fp", shingle: int = 3) -> DataFrame:
    """``df`` with the fingerprint as a signed long in ``out_col``."""
    rest = df.drop(out_col)
    at = rest.columns.index(text_col)
    schema = rest.select("*", F.lit(None).cast("long").alias(out_col)).schema

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint_of(t, shingle) for t in batch.column(at).to_pylist()], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps)], [*batch.schema.names, out_col])

    return map_arrow(rest, each, schema)


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def linked(a: np.ndarray, b: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """A spanning forest, as pairs of fingerprints, of the links within ``a`` (b is None) or between a and b.

    Every fingerprint of the second side is looked at by every one of the first: exact.
    """
    nodes = a if b is None else np.concatenate([a, b])
    first = 0 if b is None else len(a)
    other = nodes[first:]
    labels = np.arange(len(nodes))
    step = max(1, BLOCK // max(1, len(other)))
    for at in range(0, len(a), step):
        near = np.bitwise_count(a[at : at + step, None] ^ other[None, :]) <= radius
        if b is None:
            near[:, : at + 1] &= False
        for r in np.nonzero(near.any(1))[0].tolist():
            i = at + r
            found = np.nonzero(near[r])[0] + first
            roots = labels[found]
            low = min(int(roots.min()), int(labels[i]))
            if labels[i] != low or (roots != low).any():
                labels[np.isin(labels, np.append(roots, labels[i]))] = low
    moved = np.nonzero(labels != np.arange(len(nodes)))[0]
    return list(zip(nodes[moved].tolist(), nodes[labels[moved]].tolist(), strict=True))


def parts_for(distinct: int) -> int:
    """In how many parts population counts are taken: what is compared shrinks as the corpus grows."""
    return 1 if distinct < 20_000 else 2 if distinct < 2_000_000 else 4


def _cell(fp: Column, parts: int) -> Column:
    """The parts' population counts as one number, 7 bits each."""
    width = 64 // parts
    mask = F.lit((1 << width) - 1 if width < 64 else -1)
    return sum((F.bit_count(F.shiftrightunsigned(fp, k * width).bitwiseAND(mask)).cast("long") * (1 << (7 * k)) for k in range(parts)), F.lit(0))


def _offsets(parts: int, radius: int) -> list[int]:
    """Differences of cell numbers, zero or above, whose counts differ by at most the radius in sum."""
    found = [(0, 0)]
    for k in range(parts):
        found = [(d + (x << (7 * k)), used + abs(x)) for d, used in found for x in range(-radius, radius + 1) if used + abs(x) <= radius]
    return sorted(d for d, _ in found if d >= 0)


def links(fps: DataFrame, radius: int = 3, parts: int | None = None, tile: int = TILE) -> DataFrame:
    """(u, v): a forest for each pair of tiles that together connect all fingerprints (column fp, distinct) within the radius."""
    parts = parts or parts_for(fps.count())
    size = fps.withColumn("cell", _cell(F.col("fp"), parts))
    cells = checkpoint(size.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).withColumn("split", F.ceil(F.col("n") / tile).cast("int")))
    near = cells.select(F.col("cell").alias("ca"), F.col("split").alias("na"), F.col("n").alias("a"), F.explode(F.array(*[F.col("cell") + d for d in _offsets(parts, radius)])).alias("cb"))
    near = near.join(cells.select(F.col("cell").alias("cb"), F.col("split").alias("nb"), F.col("n").alias("b")), "cb")
    work = near.agg(F.sum(F.col("a").cast("double") * F.col("b"))).first()[0] or 0.0
    pairs = near.select("ca", "cb", "na", "nb", F.explode(F.expr("sequence(0, na - 1)")).alias("ta")).select("*", F.explode(F.expr("sequence(0, nb - 1)")).alias("tb"))
    pairs = pairs.where("ca < cb or ta <= tb").select(F.struct("ca", "ta", "cb", "tb").alias("pair"), "ca", "ta", "cb", "tb")
    members = size.join(cells, "cell").select("fp", "cell", F.pmod(F.xxhash64("fp"), "split").cast("int").alias("t"))
    tiles = checkpoint(members.groupBy("cell", "t").agg(F.collect_list("fp").alias("fps")))
    sides = pairs.select(F.col("ca").alias("cell"), F.col("ta").alias("t"), "pair", F.lit(0).alias("side"))
    sides = sides.unionByName(pairs.where("ca <> cb or ta <> tb").select(F.col("cb").alias("cell"), F.col("tb").alias("t"), "pair", F.lit(1).alias("side")))
    tasks = max(fps.sparkSession.sparkContext.defaultParallelism, min(100_000, int(work / TASK)))
    dealt = tiles.join(sides, ["cell", "t"]).select("pair", "side", "fps").repartition(tasks, "pair")

    def compare(rows: pa.Table) -> pa.Table:
        tile_of = dict(zip(rows.column("side").to_pylist(), rows.column("fps"), strict=True))
        own = {side: x.values.to_numpy().view(np.uint64) for side, x in tile_of.items()}
        pair = rows.column("pair")[0].as_py()
        alone = pair["ca"] == pair["cb"] and pair["ta"] == pair["tb"]
        found = linked(own[0], None, radius) if alone else linked(own[0], own[1], radius) if len(own) == 2 else []
        pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.table({"u": pairs[:, 0], "v": pairs[:, 1]})

    return dealt.groupBy("pair").applyInArrow(compare, "u long, v long")


def components(rows: DataFrame, radius: int = 3) -> DataFrame:
    """(fp, component_fp, component_id) of each distinct fingerprint in ``rows`` (id, fp): its component's smallest fingerprint and smallest id."""
    reps = checkpoint(rows.groupBy("fp").agg(F.min("id").alias("id")))
    joined = checkpoint(connected_components(links(reps.select("fp"), radius)))
    all_fps = reps.join(joined.withColumnsRenamed({"node": "fp", "component": "component_fp"}), "fp", "left")
    all_fps = all_fps.withColumn("component_fp", F.coalesce("component_fp", "fp"))
    lowest = all_fps.groupBy("component_fp").agg(F.min("id").alias("component_id"))
    return all_fps.select("fp", "component_fp").join(lowest, "component_fp")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, shingle: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id), a row for each row of ``df``."""
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = checkpoint(with_fingerprint(docs, "text", "fp", shingle).select("id", "fp"))
    found = components(rows, radius)
    return rows.join(found, "fp").select(F.col("id").alias("doc_id"), hex16(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, shingle: int = 3) -> DataFrame:
    """The rows of ``df`` that stay: of each component, one row with its smallest id (nulls last).

    Fingerprints are taken twice, so that texts aren't kept for the comparison; the texts move once,
    to meet the keys that stay, which no two components share.
    """
    names = df.columns
    fp, key = free_name(df, "_fp"), free_name(df, "_key")
    ids = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = checkpoint(with_fingerprint(ids, "text", "fp", shingle).select("id", "fp").groupBy("fp").agg(F.min("id").alias("id")))
    found = components(rows, radius)
    best = rows.join(found, "fp").where(F.col("id").eqNullSafe(F.col("component_id")))
    stay = checkpoint(best.groupBy("component_fp").agg(F.min("fp").alias(fp)).join(found.select("component_fp", "component_id").distinct(), "component_fp").select(fp, F.col("component_id").alias("keep")))
    text_of = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    full = with_fingerprint(df, text_col, fp, shingle).withColumn(key, text_of(id_col))
    left = full.join(stay.select(fp, text_of("keep").alias(key)), [fp, key], "left_semi")
    return left.dropDuplicates([fp, key]).select(*names)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
