"""Shared pieces: tables written to the shared folder, blocks of rows, and connected components."""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.sources.shared import discard, shared_dir, written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """``df`` written to the shared folder in buckets of ``key``, so that what comes back to a key meets its rows where they
    are. The catalog entry goes at once, the files stay."""
    spark, name = df.sparkSession, f"pixelweave_{uuid.uuid4().hex}"
    writer = df.write.format("parquet").option("compression", "zstd").option("path", f"{shared_dir(spark)}/{name}")
    writer.bucketBy(shuffle_partitions(spark), key).saveAsTable(name)
    out = spark.table(name).select("*")
    spark.sql(f"DROP TABLE {name}")  # an external table: out has already been resolved to its files
    return out


def _blocks(limit: int, size: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), itertools.count()
        held: list[pa.StructArray] = []
        chars = 0

        def block() -> pa.RecordBatch:
            rows = pa.concat_arrays(held)
            held.clear()
            rows = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)
            return pa.RecordBatch.from_arrays([pa.array([(part << 24) | next(number)], pa.int64()), rows], ["_block", "_rows"])

        for batch in batches:
            rows, start = pa.StructArray.from_arrays(batch.columns, batch.schema.names), 0
            for i, n in enumerate(pc.binary_length(batch.column(size)).fill_null(0).to_pylist()):
                chars += n + 1
                if chars >= limit:
                    held.append(rows[start : i + 1])
                    start, chars = i + 1, 0
                    yield block()
            if start < len(rows):
                held.append(rows[start:])
        if held:
            yield block()

    return run


def row_blocks(rows: DataFrame, limit: int) -> DataFrame:
    """``rows``, whose last column is a text, in blocks of about ``limit`` bytes of text: ``_block long, _rows array<struct>``,
    written in buckets of ``_block`` by the tasks that read them, without a shuffle. A longer text is a block of its own."""
    kinds = ",".join(f"`{n}`:{t}" for n, t in rows.dtypes)
    return bucketed(rows.mapInArrow(_blocks(limit, rows.columns[-1]), f"_block long, _rows array<struct<{kinds}>>"), "_block")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges (_a long, _b long)``: returns ``(_node, _comp)``, _comp the smallest node reached.

    Each round every node takes the smallest label among its neighbours and then its label's label (pointer jumping),
    so a path of length n takes about log n rounds. Nodes without an edge are not in the result. Repeated edges and
    loops are harmless; an empty frame gives an empty result. Labels are written to the shared folder each round, and
    those of the round before are deleted.
    """
    both = edges.select("_a", "_b").union(edges.select(F.col("_b").alias("_a"), F.col("_a").alias("_b")))
    both = written(both.distinct())
    now = written(both.groupBy(F.col("_a").alias("_node")).agg(F.least(F.min("_a"), F.min("_b")).alias("_comp")))
    for _ in range(max_rounds):
        labels = now.select("_node", "_comp")
        near = (
            both.join(labels.select(F.col("_node").alias("_b"), F.col("_comp").alias("_l")), "_b")
            .groupBy(F.col("_a").alias("_node"))
            .agg(F.min("_l").alias("_l"))
        )
        step = labels.join(near, "_node", "left").select(
            "_node", F.col("_comp").alias("_old"), F.least("_comp", F.coalesce("_l", "_comp")).alias("_comp")
        )
        step = written(step)
        jump = step.select(F.col("_node").alias("_comp"), F.col("_comp").alias("_to"))
        new = written(step.join(jump, "_comp", "left").select("_node", "_old", F.coalesce("_to", "_comp").alias("_comp")))
        discard(step, now)
        now = new
        if now.filter(F.col("_old") != F.col("_comp")).isEmpty():
            discard(both)
            return now.select("_node", "_comp")
    raise RuntimeError(f"labels still changed after {max_rounds} rounds")
