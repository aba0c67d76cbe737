"""Line dedup: a sharded minimal perfect hash over the distinct line hashes, probed instead of joined.

1. Every line's key gets a 128-bit hash; per distinct hash the smallest doc_id and the number of holders are counted.
2. All distinct hashes are dealt into shards of about ``SHARD_KEYS``. Each shard becomes one row: a minimal perfect hash
   and three flat arrays behind it: 32-bit fingerprint, count of holders (one byte, 255 stands for more), first holder.
3. Documents probe: their (hash, doc_id) pairs, without any text, go to the shards and are looked up in the arrays. A line
   whose count says two or more and whose first holder is another document goes to the document's drop set. A shard with
   many probes is copied to several probing groups.
4. Documents drop the lines whose hash is in their drop set.

Texts are written once in blocks, next to the hashes, and stay there: only drop sets move to the blocks.

Defined cases: null or empty text is one empty line; a null doc_id counts as one document that comes before all others;
rows with equal doc_id are one document (what is decided for it applies to each row); keys of fewer than
``min_chars`` code points always stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.llm.common import discard, row_blocks, shuffle_partitions, table, written

STRIP = " \t\n\x0b\x0c\r"
NO_ID = -(2**63)
GAMMA = 1.6
SHARD_KEYS = 500_000
BLOCK_CHARS = 4_000_000


def line_hash(line: str, min_chars: int) -> bytes | None:
    key = line.strip(STRIP)
    if len(key) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass").lower())  # bytes.lower() touches A-Z only


def _mix(keys: np.ndarray, level: int) -> np.ndarray:
    """splitmix64 finaliser, seeded by the level."""
    z = keys + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: one bit array a level; keys that collide go on to the next level."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        ones = [np.unpackbits(x, bitorder="little").astype(np.int64) for x in levels]
        start, self.ranks = 0, []
        for x in ones:
            self.ranks.append(start + np.cumsum(x) - x)
            start += int(x.sum())
        self.ones, self.size = ones, start

    @staticmethod
    def build(keys: np.ndarray) -> PerfectHash:
        levels, rest = [], keys
        while len(rest):
            bits = max(8, -(-int(GAMMA * len(rest)) // 8) * 8)
            at = (_mix(rest, len(levels)) % np.uint64(bits)).astype(np.int64)
            alone = np.bincount(at, minlength=bits) == 1
            levels.append(np.packbits(alone.astype(np.uint8), bitorder="little"))
            rest = rest[~alone[at]]
            if len(levels) > 200:
                raise ValueError("keys are not distinct")
        return PerfectHash(levels)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 where no level has it. Keys outside the set may get any slot: check the fingerprint."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, (ones, ranks) in enumerate(zip(self.ones, self.ranks, strict=True)):
            if not len(open_):
                break
            at = (_mix(keys[open_], level) % np.uint64(len(ones))).astype(np.int64)
            hit = ones[at] == 1
            out[open_[hit]] = ranks[at[hit]]
            open_ = open_[~hit]
        return out


def _hash_lines(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, rows in zip(batch.column(0), batch.column(1), strict=True):
                docs, at, parts = [], [], []
                ids, texts = (rows.values.field(name).to_pylist() for name in ("_id", "_text"))
                for i, (doc, text) in enumerate(zip(ids, texts, strict=True)):
                    own = {h for line in (text or "").split("\n") if (h := line_hash(line, min_chars))}
                    docs.append(np.full(len(own), NO_ID if doc is None else doc, np.int64))
                    at.append(np.full(len(own), i, np.int32))
                    parts.extend(own)
                h = np.frombuffer(b"".join(parts), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(h[:, 0].copy()),
                        pa.array(h[:, 1].copy()),
                        pa.array(np.concatenate(docs) if docs else np.empty(0, np.int64)),
                        pa.array(np.full(len(h), block.as_py(), np.int64)),
                        pa.array(np.concatenate(at) if at else np.empty(0, np.int32)),
                    ],
                    ["_h", "_f", "_doc", "_block", "_at"],
                )

    return run


def short(fingerprint: np.ndarray) -> np.ndarray:
    return (fingerprint & 0xFFFFFFFF).astype(np.uint32)


def line_index(hashes: DataFrame, shards: int) -> DataFrame:
    """``hashes (_h, _f, _doc)`` to one row a shard: ``_shard, _levels, _fp, _count, _first``, of all distinct hashes."""

    def build(key, t):
        h = t.column("_h").to_numpy().view(np.uint64)
        mph = PerfectHash.build(h)
        at = mph.index(h)
        out = []
        for values in (short(t.column("_f").to_numpy()), np.minimum(t.column("_n").to_numpy(), 255).astype(np.uint8), t.column("_min").to_numpy()):
            flat = np.empty_like(values)
            flat[at] = values
            out.append(pa.array([flat.tobytes()], pa.binary()))
        return pa.Table.from_arrays(
            [pa.array([key[0].as_py()], pa.int64()), pa.array([[x.tobytes() for x in mph.levels]], pa.list_(pa.binary())), *out],
            ["_shard", "_levels", "_fp", "_count", "_first"],
        )

    lines = hashes.groupBy("_h", "_f").agg(F.min("_doc").alias("_min"), F.count("*").alias("_n"))
    # Two different lines whose first 64 bits agree cannot share a slot: the later fingerprint moves to a shard of its own.
    alone = lines.groupBy("_h").agg(F.sort_array(F.collect_list(F.struct("_f", "_n", "_min"))).alias("_rows"))
    rows = alone.select("_h", F.posexplode("_rows").alias("_i", "_r")).select(
        "_h", "_r.*", (F.pmod("_h", F.lit(shards)) + F.col("_i") * shards).cast("long").alias("_shard")
    )
    return rows.groupBy("_shard").applyInArrow(build, "_shard long, _levels array<binary>, _fp binary, _count binary, _first binary")


def _probe(key, left, right):
    h, f, d = (left.column(c).to_numpy() for c in ("_h", "_f", "_doc"))
    drop = np.zeros(len(h), bool)
    for row in right.to_pylist():
        mph = PerfectHash([np.frombuffer(x, np.uint8) for x in row["_levels"]])
        at = mph.index(h.view(np.uint64))
        slot = np.maximum(at, 0)
        known = (at >= 0) & (np.frombuffer(row["_fp"], np.uint32)[slot] == short(f))
        drop |= known & (np.frombuffer(row["_count"], np.uint8)[slot] >= 2) & (np.frombuffer(row["_first"], np.int64)[slot] != d)
    digests = np.stack([h[drop], f[drop]], axis=1).tobytes()
    keys = pa.array([digests[i : i + 16] for i in range(0, len(digests), 16)], pa.binary())
    return pa.table({"_block": left.column("_block").filter(drop), "_at": left.column("_at").filter(drop), "_key": keys})


def drop_sets(hashes: DataFrame, per_group: int | None = None) -> DataFrame:
    """``(_block, _drops array<struct<_at, _key>>)``: for each block the hashes of lines that an earlier document holds."""
    spark = hashes.sparkSession
    total = hashes.count()
    wide = shuffle_partitions(spark)
    per_group = per_group or max(1, min(SHARD_KEYS, -(-total // (4 * wide))))
    shards = max(1, -(-total // SHARD_KEYS), min(4 * wide, -(-total // per_group)))
    index = written(line_index(hashes, shards))
    # How many probing groups each shard needs, from exact counts; the arrays are copied to each of them.
    load = (
        hashes.groupBy(F.pmod("_h", F.lit(shards)).alias("_s"))
        .count()
        .select("_s", F.greatest(F.ceil(F.col("count") / per_group), F.lit(1)).cast("int").alias("_groups"))
    )
    load = written(load)
    copies = index.join(load, F.pmod("_shard", F.lit(shards)) == F.col("_s")).select(
        "_s", F.explode(F.sequence(F.lit(0), F.col("_groups") - 1)).alias("_g"), "_levels", "_fp", "_count", "_first"
    )
    # load has one row a shard, so its size follows the number of shards, not of lines; Spark picks the join.
    probes = hashes.withColumn("_s", F.pmod("_h", F.lit(shards))).join(load, "_s").withColumn(
        "_g", F.pmod(F.xxhash64("_doc", "_f"), F.col("_groups").cast("long")).cast("int")
    )
    found = (
        probes.select("_s", "_g", "_h", "_f", "_doc", "_block", "_at")
        .groupBy("_s", "_g")
        .cogroup(copies.groupBy("_s", "_g"))
        .applyInArrow(_probe, "_block long, _at int, _key binary")
    )
    out = written(found.groupBy("_block").agg(F.collect_list(F.struct("_at", "_key")).alias("_drops")))
    discard(index, load)
    return out


def _apply(min_chars: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, drops in zip(*batch.columns, strict=True):
                gone: dict[int, set[bytes]] = {}
                for drop in drops.as_py() or ():
                    gone.setdefault(drop["_at"], set()).add(drop["_key"])
                kept, total, dropped = [], [], []
                for i, text in enumerate(rows.values.field("_text").to_pylist()):
                    lines = (text or "").split("\n")
                    stay = [x for x in lines if line_hash(x, min_chars) not in gone[i]] if i in gone else lines
                    kept.append("\n".join(stay))
                    total.append(len(lines))
                    dropped.append(len(lines) - len(stay))
                yield pa.RecordBatch.from_arrays(
                    [*map(rows.values.field, names), pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(dropped, pa.int64())],
                    [*names, "_kept", "_n_lines", "_n_dropped"],
                )

    return run


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row of ``docs``: the id, the ``keep`` columns, ``_kept`` (remaining text), ``_n_lines``, ``_n_dropped``."""
    names = [f"_c{i}" for i in range(len(keep) + 1)]
    cols = [F.col(c).alias(n) for c, n in zip((id_col, *keep), names, strict=True)]
    rows = docs.select(*cols, F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    blocks = row_blocks(rows, BLOCK_CHARS)
    hashes = written(blocks.mapInArrow(_hash_lines(min_chars), "_h long, _f long, _doc long, _block long, _at int"))
    drops = drop_sets(hashes)
    discard(hashes)
    met = blocks.join(drops.hint("shuffle_merge"), "_block", "left").select("_rows", "_drops")
    kinds = ", ".join(f"{n} {t}" for n, t in rows.dtypes[: len(names)])
    out = met.mapInArrow(_apply(min_chars, names), f"{kinds}, _kept string, _n_lines long, _n_dropped long")
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, (id_col, *keep), strict=True)], "_kept", "_n_lines", "_n_dropped")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        F.col("_n_lines").alias("n_lines"),
        F.col("_n_dropped").alias("n_dropped"),
        F.sha2(F.col("_kept").cast("binary"), 256).alias("kept_sha256"),
    )


OP5_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.*, coalesce(r.first <> k.doc_id, false) AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(gone::INT) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
