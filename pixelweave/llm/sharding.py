"""Sharding by histogram sort: exact byte counts below key boundaries are refined until the splitters are found.

Rows are ordered by (hash of the text, doc_id, row number), so equal texts lie together and a group of copies is cut
only where a shard is full. A splitter is found by counting: each round one job sums the bytes per bin of the key
interval in which a splitter lies (``BINS`` bins), and the interval shrinks to the bin that crosses the splitter's
target, until the bytes below its edge are within ``tolerance`` of the target. If the interval is a single hash (a hot
group of copies), the search goes on inside it by doc_id, then by row number. Only bin sums reach the driver; their
number depends on the number of splitters, not on the rows. With all splitters known, rows are exchanged once.

``write_shards`` exchanges whole rows by the splitters and writes them; ``shard_by_bytes`` says where each row goes.

The law is ``bytes``: shard sizes differ by at most the tolerance or one row. Defined cases: a null text has size 1 and
crc32 0; null doc_ids sort first; repeated rows are separate rows; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelweave.llm.common import table, written

BINS = 512
KEYS = ("_h", "_d", "_r")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """Size, crc32 and the three key columns of a row, none of the keys negative."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    low = F.lit(-(2**62))
    return [
        (F.octet_length(text) + 1).cast("long").alias("_size"),
        F.crc32(text.cast("binary")).alias("_crc"),
        F.shiftrightunsigned(F.xxhash64(text), 2).alias("_h"),
        # Order of doc_id as an offset from the smallest quarter of the range; ids beyond it share the end.
        (F.greatest(F.least(F.coalesce(F.col(f"`{id_col}`").cast("long"), low), F.lit(2**62 - 1)), low) - low).alias("_d"),
        F.monotonically_increasing_id().alias("_r"),
    ]


def sort_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One narrow row a document: id, size, crc32 and keys."""
    return written(docs.select(F.col(f"`{id_col}`").alias("_id"), *keyed(docs, id_col, text_col)))


def find_splitters(rows: DataFrame, targets: list[int], tolerance: int) -> list[tuple[int, ...]]:
    """For each target a key prefix: the bytes of the rows before it are within tolerance, or one row, of the target."""
    # A search: the target, the key values already fixed, the interval of the next key, the bytes before the interval.
    open_ = {i: (t, (), 0, 2**62 - 1, 0) for i, t in enumerate(targets)}
    done: dict[int, tuple[int, ...]] = {}
    while open_:
        live = sorted({(prefix, lo, hi) for _, prefix, lo, hi, _ in open_.values()})
        which, value, bin_ = F.lit(None).cast("int"), F.lit(None).cast("long"), F.lit(None).cast("long")
        for n, (prefix, lo, hi) in enumerate(live):
            key = KEYS[len(prefix)]
            inside = F.col(key).between(lo, hi)
            for name, fixed in zip(KEYS, prefix, strict=False):
                inside = inside & (F.col(name) == fixed)
            which, value = F.when(inside, n).otherwise(which), F.when(inside, F.col(key)).otherwise(value)
            bin_ = F.when(inside, F.expr(f"({key} - {lo}L) div {_step(lo, hi)}L")).otherwise(bin_)
        sums = rows.select(which.alias("_w"), bin_.alias("_b"), value.alias("_v"), "_size").filter("_w IS NOT NULL").groupBy("_w", "_b")
        sums = sums.agg(F.sum("_size"), F.count("*"), F.min("_v"), F.max("_v")).collect()
        bins: dict[int, list[tuple[int, ...]]] = {}
        for w, _, size, count, least, most in sums:
            bins.setdefault(w, []).append((least, most, size, count))
        for i, (target, prefix, lo, hi, at) in list(open_.items()):
            for least, most, size, count in sorted(bins.get(live.index((prefix, lo, hi)), [])):
                if abs(at - target) <= tolerance:
                    done[i] = (*prefix, least)
                elif at + size - target <= tolerance:
                    at += size
                    continue
                elif count == 1 or (least == most and len(prefix) + 1 == len(KEYS)):  # one row: to the nearer side
                    done[i] = (*prefix, least if target - at < at + size - target else least + 1)
                elif least == most:
                    open_[i] = (target, (*prefix, least), 0, 2**63 - 1, at)
                else:
                    open_[i] = (target, prefix, least, most, at)
                break
            else:
                done[i] = (*prefix, hi + 1 if hi < 2**63 - 1 else hi)
        open_ = {i: s for i, s in open_.items() if i not in done}
    return [done[i] for i in range(len(targets))]


def _step(lo: int, hi: int) -> int:
    return -(-(hi - lo + 1) // BINS)


def _above(splitter: tuple[int, ...]) -> Column:
    """Whether the row's key is at or after the splitter."""
    out = F.col(KEYS[len(splitter) - 1]) >= splitter[-1]
    for name, value in reversed(list(zip(KEYS, splitter[:-1], strict=False))):
        out = (F.col(name) > value) | ((F.col(name) == value) & out)
    return out


def _dealt(rows: DataFrame, shards: int, parts: int, tolerance: float) -> tuple[Column, Column]:
    """The range and the shard of a row of ``rows``, by splitters found in them."""
    total = rows.agg(F.sum("_size")).first()[0] or 0
    ranges = shards * parts
    targets = [total * i // ranges for i in range(1, ranges)]
    found = find_splitters(rows, targets, int(total / shards * tolerance)) if total else []
    number, shard = F.lit(0), F.lit(0)
    for s in sorted(set(found)):
        number = number + _above(s).cast("int")
    for i in range(1, shards):
        if found:
            shard = shard + _above(found[i * parts - 1]).cast("int")
    return number.alias("_range"), shard.alias("_shard")


def _slots(dealt: DataFrame, counts: DataFrame) -> DataFrame:
    """``dealt`` with ``_slot``; ``counts (_shard, _range, count)`` has at most shards x parts rows."""
    before = counts.select("_shard", "_range", (F.sum("count").over(Window.partitionBy("_shard").orderBy("_range")) - F.col("count")).alias("_before"))
    at = F.row_number().over(Window.partitionBy("_shard", "_range").orderBy(*KEYS)) - 1
    out = dealt.withColumn("_in", at).join(F.broadcast(before), ["_shard", "_range"])
    return out.withColumn("_slot", (F.col("_in") + F.col("_before")).cast("long"))


def shard_by_bytes(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", parts: int = 8, tolerance: float = 1e-4) -> DataFrame:
    """Per row of ``docs``: id, ``_size``, ``_crc``, ``_shard``, ``_slot`` (gapless from 0 in key order).

    ``parts`` ranges make up each shard, so that ordering a shard is the work of several tasks.
    """
    rows = sort_keys(docs, id_col, text_col)
    dealt = written(rows.select("_id", "_size", "_crc", *KEYS, *_dealt(rows, shards, parts, tolerance)))
    out = _slots(dealt, dealt.groupBy("_shard", "_range").count())
    return out.select(F.col("_id").alias(id_col), "_size", "_crc", "_shard", "_slot")


def write_shards(docs: DataFrame, path: str, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", parts: int = 8, tolerance: float = 1e-4) -> DataFrame:
    """Whole rows of ``docs`` exchanged once, by splitters found on their narrow keys, and written to ``path`` as
    ``_shard=0, 1, ...``, each in ``parts`` ranges that are sorted by ``_slot``. Returns the table: ``_row`` (the columns of
    ``docs``), ``_size``, ``_slot``, ``_shard``."""
    rows = sort_keys(docs, id_col, text_col)
    to = _dealt(rows, shards, parts, tolerance)
    counts = written(rows.select(*to).groupBy("_shard", "_range").count())
    full = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *keyed(docs, id_col, text_col)).select("_row", "_size", *KEYS, *to)
    out = _slots(full, counts).select("_row", "_size", "_slot", "_shard")
    out.write.partitionBy("_shard").parquet(path)
    return docs.sparkSession.read.schema(out.schema).parquet(path)


def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_by_bytes(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("_shard").cast("int").alias("shard"),
        F.col("_slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
