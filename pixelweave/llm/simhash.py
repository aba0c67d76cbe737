"""SimHash near-dedup by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits, each padded to a 23-bit word of the binary Golay code,
whose balls of radius 3 fill the space: every word has exactly one nearest codeword. If two fingerprints differ in at
most two bits, then for one of the three cyclic segment pairs (X, Y) segment X is equal and segment Y differs in at
most one bit (pigeonhole). So a fingerprint is stored under (X, codeword of Y) and asks under (X, codeword of each word
at distance 0 or 1 from Y): several keys each. Pairs that meet are verified by bit count.

Only distinct fingerprints take part; copies are one class from the start. A key that holds very many distinct
fingerprints (``HOT_KEY``) would make pairs with the square of its size: its fingerprints are instead joined under all
C(64,2) ways to blank two bits, which is exact as well and linear.

Defined cases: null and empty texts (no words) have fingerprint zero and link like any other; rows with equal doc_id are
separate rows of one class id; a null doc_id never gives a component its name unless it holds nothing else.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.llm.common import components, shuffle_partitions, table, written

SEGMENTS = ((0, 22), (22, 21), (43, 21))
GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, of the (23, 12) code
HOT_KEY = 4000
CHUNK = 1 << 15


def _remainders(words: np.ndarray) -> np.ndarray:
    """Remainder of each 23-bit word by the generator polynomial: its syndrome."""
    r = words.astype(np.int64)
    for bit in range(22, 10, -1):
        r = np.where((r >> bit) & 1, r ^ (GENERATOR << (bit - 11)), r)
    return r


def _error_table() -> np.ndarray:
    """Syndrome to the only error pattern of at most three bits that has it."""
    one = 1 << np.arange(23)
    errors = {0}
    for _ in range(3):
        errors |= {e | int(b) for e in errors for b in one}
    errors = np.array(sorted(errors))
    out = np.zeros(1 << 11, np.int64)
    out[_remainders(errors)] = errors
    return out


ERRORS = _error_table()


def nearest_codeword(words: np.ndarray) -> np.ndarray:
    """12-bit index (the message bits) of the codeword nearest to each 23-bit word."""
    return (words ^ ERRORS[_remainders(words)]) >> 11


def near_codewords(words: np.ndarray, width: int) -> np.ndarray:
    """(n, width + 1): codewords nearest to each word and to each word with one of its ``width`` bits flipped."""
    flips = np.concatenate([[0], 1 << np.arange(width)])
    return nearest_codeword(words[:, None] ^ flips[None, :])


SPACE = re.compile(rb"[ \t\n\x0b\x0c\r]+")


def fingerprint(text: str | None) -> int:
    words = [w for w in SPACE.split((text or "").encode("utf-8", "surrogatepass").lower()) if w]
    if not words:
        return 0
    if len(words) < 3:
        shingles = [b" ".join(words)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        shingles = [joined[a:b] for a, b in zip(starts[:-2].tolist(), ends[2:].tolist(), strict=True)]
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(s, 42) for s in shingles), np.uint64, len(shingles)))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the 64-bit hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), CHUNK):
        ones += np.unpackbits(hashes[i : i + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def _fingerprints(n_cols: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(x.as_py()) for x in batch.column(n_cols)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_cols], pa.array(fp)], [*batch.schema.names[:n_cols], "_fp"])

    return run


def with_fingerprint(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns and ``_fp`` (the unsigned 64 bits as a long)."""
    base = docs.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(keep)], F.col(text_col).cast("string").alias("_text"))
    kinds = ", ".join(f"{n} {t}" for n, t in base.dtypes[: len(keep)])
    out = base.mapInArrow(_fingerprints(len(keep)), f"{kinds}, _fp long")
    return out.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(keep)], "_fp")


def _keys(ask: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signed = batch.column(0).to_numpy()
            fp = signed.view(np.uint64)
            part = [((fp >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in SEGMENTS]
            keys, owners = [], []
            for i, (_, width) in enumerate(SEGMENTS):
                j = (i + 1) % 3
                words = part[j]
                codes = near_codewords(words, SEGMENTS[j][1]) if ask else nearest_codeword(words)[:, None]
                key = (np.int64(i) << 40) | (part[i][:, None] << 12) | codes
                keys.append(key.ravel())
                owners.append(np.repeat(signed, codes.shape[1]))
            pairs = np.stack([np.concatenate(keys), np.concatenate(owners)], axis=1) if len(fp) else np.empty((0, 2), np.int64)
            pairs = np.unique(pairs, axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["_key", "_fp"])

    return run


def links(fps: DataFrame, hot_key: int = HOT_KEY) -> DataFrame:
    """``fps (_fp)`` distinct: pairs ``(_a, _b)`` of fingerprints that differ in one or two bits."""
    # A fingerprint gives 66 keys: the narrow rows are dealt out first, however few files they were written to.
    fps = fps.select("_fp").repartition(shuffle_partitions(fps.sparkSession), "_fp")
    stored = fps.mapInArrow(_keys(False), "_key long, _fp long")
    asked = fps.mapInArrow(_keys(True), "_key long, _fp long")
    hot = written(stored.groupBy("_key").count().filter(F.col("count") > hot_key).select("_key"))
    a, b = stored.join(hot, "_key", "left_anti"), asked.join(hot, "_key", "left_anti")
    near = F.bit_count(F.col("a._fp").bitwiseXOR(F.col("b._fp")))
    # A pair may meet from either side or under two keys; the order of the two is normalised and repeats fall to distinct().
    cool = a.alias("a").join(b.alias("b"), (F.col("a._key") == F.col("b._key")) & near.between(1, 2))
    pairs = cool.select(F.least("a._fp", "b._fp").alias("_a"), F.greatest("a._fp", "b._fp").alias("_b"))
    if not hot.isEmpty():
        pairs = pairs.union(_blanked_links(stored.union(asked).join(hot, "_key", "left_semi").select("_fp").distinct()))
    return pairs.distinct()


def _blanked_links(fps: DataFrame) -> DataFrame:
    bits = F.sequence(F.lit(0), F.lit(63))
    masks = F.flatten(
        F.transform(bits, lambda i: F.transform(F.filter(bits, lambda j: j > i), lambda j: F.call_function("shiftleft", F.lit(1).cast("long"), i).bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), j))))
    )
    blank = fps.select("_fp", F.explode(masks).alias("_m")).select("_fp", "_m", F.col("_fp").bitwiseAND(F.bitwise_not("_m")).alias("_rest"))
    a, b = blank.alias("a"), blank.alias("b")
    same = (F.col("a._m") == F.col("b._m")) & (F.col("a._rest") == F.col("b._rest")) & (F.col("a._fp") < F.col("b._fp"))
    return a.join(b, same).select(F.col("a._fp").alias("_a"), F.col("b._fp").alias("_b"))


def near_classes(marked: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``marked (id, _fp)``: one row a distinct fingerprint: ``_comp`` (smallest fingerprint reachable), ``_component`` (smallest id)."""
    classes = written(marked.groupBy("_fp").agg(F.min(id_col).alias("_first")))
    comp = components(links(classes))
    named = classes.join(comp.withColumnRenamed("_node", "_fp"), "_fp", "left").select("_fp", "_first", F.coalesce("_comp", "_fp").alias("_comp"))
    smallest = named.groupBy("_comp").agg(F.min("_first").alias("_component"))
    return named.join(smallest, "_comp").select("_fp", "_comp", "_component")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: the id, ``_fp`` and ``_component``, the smallest id reachable over links."""
    marked = written(with_fingerprint(docs, text_col, (id_col,)))
    return marked.join(near_classes(marked, id_col), "_fp").select(id_col, "_fp", "_comp", "_component")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), F.col("_component").alias("component_id"))
