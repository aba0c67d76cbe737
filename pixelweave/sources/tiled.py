"""Layers stored a tile a row, in buckets of the tile, so that layers of one grid meet without a shuffle.

A tile is the long ``tile row * 2**32 + tile column`` with an array of side * side places in row order: NULL where there is
no pixel, a struct with a NULL value where a pixel has no data. Rows are sorted by tile, so a range of pixel rows skips the row
groups of other tiles. Every layer written with the same side and number of buckets can be stacked as it lies.

A layer is a folder of versions: a write that fails at any point leaves the layer that was there.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from pixelweave.sources.versions import newest, write_version

SIDE, BUCKETS = 256, 64
GROUP_TILES = 16  # tiles in a row group, the least that a scan reads


@dataclass(frozen=True)
class TiledLayer:
    """``tiles (_tile long, _px array<struct<value>>)`` of a layer."""

    tiles: DataFrame
    side: int

    def rows(self, low: int, high: int) -> TiledLayer:
        """The tiles with pixels of the rows ``low`` to ``high``; the scan skips the others."""
        return TiledLayer(self.tiles.filter(F.col("_tile").between(tile_key(low // self.side, 0), tile_key(high // self.side, 2**31))), self.side)

    def only(self, tiles: Sequence[int]) -> TiledLayer:
        return TiledLayer(self.tiles.filter(F.col("_tile").isin(*tiles) if tiles else F.lit(False)), self.side)

    def pixels(self, name: str = "value") -> DataFrame:
        return stack_tiles({name: self})


def tile_key(row: int, col: int) -> int:
    return (row << 32) + col


def key_of(side: int) -> Column:
    return F.floor(F.col("row") / side).cast("long") * F.lit(2**32) + F.floor(F.col("col") / side).cast("long")


def _packed(side: int) -> Callable[[tuple[pa.Scalar, ...], pa.Table], pa.Table]:
    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        tile = key[0].as_py()
        at = (t.column("row").to_numpy() - (tile >> 32) * side) * side + t.column("col").to_numpy() - (tile & 0xFFFFFFFF) * side
        take = np.full(side * side, -1, np.int64)
        take[at] = np.arange(len(at))
        none = take < 0
        values = t.column("value").combine_chunks().take(pa.array(take, mask=none))
        places = pa.StructArray.from_arrays([values], fields=[pa.field("value", values.type)], mask=pa.array(none))
        return pa.table([pa.array([tile], pa.int64()), pa.ListArray.from_arrays(pa.array([0, side * side], pa.int32()), places)], ["_tile", "_px"])

    return run


def write_tiles(df: DataFrame, path: str, side: int = SIDE, buckets: int = BUCKETS) -> None:
    """``df (row, col, value)`` as a layer: one shuffle, by tile. A place twice in ``df`` keeps one of its values."""
    spark, name = df.sparkSession, f"pixelweave_{uuid.uuid4().hex}"
    kind = dict(df.dtypes)["value"]
    tiles = df.select(key_of(side).alias("_tile"), "row", "col", "value").groupBy("_tile").applyInArrow(_packed(side), f"_tile long, _px array<struct<value:{kind}>>")
    # Each bucket is one task and one file, sorted by tile.
    dealt = tiles.repartition(buckets, "_tile").sortWithinPartitions("_tile")

    def write(folder: str) -> None:
        writer = dealt.write.format("parquet").option("path", folder).option("compression", "zstd").option("parquet.block.row.count.limit", GROUP_TILES)
        writer.bucketBy(buckets, "_tile").sortBy("_tile").saveAsTable(name)
        spark.sql(f"DROP TABLE {name}")  # an external table: its files stay

    write_version(spark, path, write, f"{side}-{buckets}")


def read_tiles(spark: SparkSession, path: str) -> TiledLayer:
    new, name = newest(spark, path), f"pixelweave_{uuid.uuid4().hex}"
    side, buckets = map(int, new.rsplit("/", 1)[1].split("-")[2:4])
    kind = dict(spark.read.parquet(new).dtypes)["_px"]
    spark.sql(f"CREATE TABLE {name} (_tile BIGINT, _px {kind}) USING parquet CLUSTERED BY (_tile) SORTED BY (_tile) INTO {buckets} BUCKETS LOCATION '{new}'")
    out = spark.table(name).select("*")
    spark.sql(f"DROP TABLE {name}")
    return TiledLayer(out, side)


def joined(layers: dict[str, TiledLayer]) -> tuple[DataFrame, int]:
    """``_tile`` and one array a layer; tiles that all layers have. Layers with the same buckets meet without a shuffle."""
    sides = {x.side for x in layers.values()}
    if len(sides) != 1:
        raise ValueError(f"layers of one stack need tiles of one side, not {sorted(sides)}")
    each = [x.tiles.select("_tile", F.col("_px").alias(f"_l{i}")) for i, x in enumerate(layers.values())]
    # Tiles are large rows in buckets: a merge join reads each bucket once, and nothing is broadcast.
    return reduce(lambda a, b: a.join(b.hint("merge"), "_tile"), each), sides.pop()


def stack_tiles(layers: dict[str, TiledLayer]) -> DataFrame:
    """``row, col`` and a column a layer, of the pixels that all layers have."""
    t, side = joined(layers)
    names = [f"_l{i}" for i in range(len(layers))]
    t = t.select("_tile", F.posexplode(F.arrays_zip(*names)).alias("_at", "_p"))
    for n in names:
        t = t.filter(F.col(f"_p.{n}").isNotNull())
    row = F.shiftright("_tile", 32) * side + F.floor(F.col("_at") / side)
    col = F.col("_tile").bitwiseAND(0xFFFFFFFF) * side + F.col("_at") % side
    return t.select(row.cast("int").alias("row"), col.cast("int").alias("col"), *[F.col(f"_p.{n}.value").alias(k) for n, k in zip(names, layers, strict=True)])


def map_stacked(layers: dict[str, TiledLayer], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``fn`` of each tile's frame (``row``, ``col`` and a column a layer), tile by tile where they lie: no shuffle."""
    t, side = joined(layers)
    names = list(layers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(batch.num_rows):
                tile = batch.column(0)[i].as_py()
                places = [c[i].values for c in batch.columns[1:]]
                there = reduce(np.logical_and, [p.is_valid().to_numpy(zero_copy_only=False) for p in places])
                at = np.flatnonzero(there)
                frame = pd.DataFrame({"row": (tile >> 32) * side + at // side, "col": (tile & 0xFFFFFFFF) * side + at % side})
                for n, p in zip(names, places, strict=True):
                    frame[n] = p.field("value").take(pa.array(at)).to_pandas()
                if len(frame):
                    yield fn(frame)

    def arrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in run(batches):
            yield from pa.Table.from_pandas(frame, schema=target, preserve_index=False).to_batches()

    target = to_arrow_schema(t.sparkSession.createDataFrame([], schema).schema)
    return t.mapInArrow(arrow, schema)
