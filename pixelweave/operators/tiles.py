"""A user's own function over tiles of pixels, over batches of rows, and over batches of a model's design; a user's own
aggregate in two phases."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelweave.operators.design import ModelSpec


def map_tiles(px: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, tile: int = 256) -> DataFrame:
    """``fn`` of each tile x tile square of pixels, a frame of at most tile² rows with the columns of ``px``."""
    names = px.columns
    keyed = px.withColumn("_tile_row", F.floor(F.col("row") / tile)).withColumn("_tile_col", F.floor(F.col("col") / tile))
    return keyed.groupBy("_tile_row", "_tile_col").applyInPandas(lambda pdf: fn(pdf[names]), schema)


FAN = 32


def scan(
    df: DataFrame,
    fn: Callable[[pd.DataFrame], Any],
    combine: Callable[[Any, Any], Any],
    finalize: Callable[[Any], pd.DataFrame],
    schema: str,
    tile: int | None = None,
    band: int | None = None,
) -> DataFrame:
    """A user's own aggregate: ``fn`` of batches of rows gives states, ``combine`` folds two of them, ``finalize`` makes rows.

    With ``tile``, ``fn`` sees one tile x tile square of pixels at a time (its keys in no column of their own). With ``band``
    there is a result a band of so many grid lines, in rows whose first column is the number of the band; without, one
    result for the whole table. Each task folds the states of its batches, and these meet in a tree of ``FAN`` states a
    merge, in the order of the partitions: a merge holds two states, whatever the number of rows or tasks. ``combine`` must
    be associative. Of an empty table nothing is finalized.
    """
    names = df.columns
    keyed = df.withColumn("_band", F.floor(F.col("row") / band) if band else F.lit(0).cast("long"))
    if tile:
        keyed = keyed.withColumn("_tr", F.floor(F.col("row") / tile)).withColumn("_tc", F.floor(F.col("col") / tile))
        states = keyed.groupBy("_band", "_tr", "_tc").applyInPandas(
            lambda key, pdf: pd.DataFrame({"_band": [key[0]], "_at": [0], "_state": [pickle.dumps(fn(pdf[names]))]}), "_band long, _at long, _state binary"
        )
    else:
        states = keyed.mapInPandas(lambda frames: _states(((b, fn(part[names])) for f in frames for b, part in f.groupby("_band")), combine), "_band long, _at long, _state binary")
    # States of one task are folded where they are; then 32 partitions meet, then 32 of these, then all.
    states = _numbered(states.mapInPandas(lambda frames: _states(((b, pickle.loads(x)) for f in frames for b, x in zip(f["_band"], f["_state"], strict=True)), combine), "_band long, _at long, _state binary"))
    for width in (FAN, FAN * FAN):
        states = states.groupBy("_band", F.floor(F.col("_at") / width).alias("_g")).applyInArrow(_folded(combine), "_band long, _at long, _state binary")

    def last(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        state = pickle.loads(_fold(pdf, combine))
        out = finalize(state)
        if band:
            out.insert(0, schema.split()[0], key[0])
        return out

    return states.groupBy("_band").applyInPandas(last, schema)


def _numbered(states: DataFrame) -> DataFrame:
    return states.withColumn("_at", F.spark_partition_id().cast("long"))


def _states(found: Iterator[tuple[int, Any]], combine: Callable[[Any, Any], Any]) -> Iterator[pd.DataFrame]:
    held: dict[int, Any] = {}
    for band, state in found:
        held[band] = combine(held[band], state) if band in held else state
    if held:
        yield pd.DataFrame({"_band": list(held), "_at": [0] * len(held), "_state": [pickle.dumps(s) for s in held.values()]})


def _fold(pdf: pd.DataFrame, combine: Callable[[Any, Any], Any]) -> bytes:
    every = pdf.sort_values("_at")["_state"].tolist()
    state = pickle.loads(every[0])
    for x in every[1:]:
        state = combine(state, pickle.loads(x))
    return pickle.dumps(state)


def _folded(combine: Callable[[Any, Any], Any]):
    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        pdf = t.select(["_at", "_state"]).to_pandas()
        return pa.table({"_band": pa.array([key[0].as_py()], pa.int64()), "_at": pa.array([int(pdf["_at"].min())], pa.int64()), "_state": pa.array([_fold(pdf, combine)], pa.binary())})

    return run


def predict_with(df: DataFrame, fn: Callable[[pd.DataFrame], pd.Series], keep: tuple[str, ...] = ("row", "col")) -> DataFrame:
    """The ``keep`` columns and ``p``: ``fn`` of each Arrow batch of rows. Nothing is shuffled."""
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[list(keep)].assign(p=fn(pdf).to_numpy(dtype=float))

    return df.mapInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", p double")


def predict_design(df: DataFrame, spec: ModelSpec, fn: Callable[[pd.DataFrame], pd.Series], keep: tuple[str, ...] = ("row", "col")) -> DataFrame:
    """The ``keep`` columns and ``p``: ``fn`` of batches of the design's columns, named by their terms, of complete rows."""
    terms = spec.terms()
    cols = [f"_x{i}" for i in range(len(terms))]
    rows = spec.complete(df).select(*keep, *[c.alias(n) for c, n in zip(spec.columns(), cols, strict=True)])
    return predict_with(rows, lambda pdf: fn(pdf[cols].set_axis(terms, axis=1)), keep)
