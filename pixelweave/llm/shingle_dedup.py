"""Near-dedup by word shingles: one row of each group of texts linked by a Jaccard similarity of ``similarity`` or more.

1. Words are split at ASCII white space and lower-cased as in ``simhash``; texts of equal words are one class. A class has
   the set of its hashed 5-word shingles (a shorter text is one shingle), the SimHash of that set, ``BANDS`` x ``ROWS``
   min-hashes of it, a key a band, and one bit of each min-hash as a sketch.
2. Candidates. SimHash fingerprints within two bits, found by the Golay keys of ``simhash.links``, give the closest copies.
   They don't reach down to 0.8 (a pair there differs in about 10 of 64 bits), so classes that share a band key are
   candidates too: each with the first class of the key (the leader), if their sketches leave the similarity possible
   (six standard deviations below it). Keys with equal members are looked at once.
3. Candidates are verified on whole shingle sets; verified links make first groups. Of each key that holds several groups,
   members of different groups are then compared, in tasks of two chunks of members each, which give only links that join
   groups. So a group of close copies costs about its size, a crowd of texts that are no links makes no rows of pairs, and no
   link between groups is lost of classes that share a key.
4. One row stays of each group of classes connected by verified links.

Texts are written once in blocks and stay there: shingle sets are made, and rows kept, where the blocks are.

A pair at exactly 0.8 shares no band key with probability (1 - 0.8^6)^32 = 0.00006; nothing below ``similarity`` is linked.

Defined cases: null and empty texts (no words) are copies of each other and of nothing else; columns of any names stay
as they are; an empty table stays empty. Of a group the row of the smallest id stays, null ids last; of equal ids one row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelweave.llm import simhash
from pixelweave.llm.common import components, discard, row_blocks, written
from pixelweave.llm.simhash import SPACE

BANDS, ROWS = 32, 6
BLOCK_CHARS = 4_000_000
CHUNK_ROWS, CHUNK_SHINGLES = 500, 2_000_000
PER_SALT = 500  # pairs that share one copy of a leader's shingle set
CHUNK = 1 << 12
_DRAW = np.random.default_rng(11)
FACTORS = _DRAW.integers(0, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _DRAW.integers(0, 2**63, BANDS * ROWS, np.uint64)
PLACES = _DRAW.integers(0, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
SKETCH = ("_s0", "_s1", "_s2")


def words_of(text: str | None) -> list[bytes]:
    return [w for w in SPACE.split((text or "").encode("utf-8", "surrogatepass").lower()) if w]


def shingle_set(words: list[bytes], size: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles."""
    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter(map(digest, words), np.uint64, len(words))
    size = min(size, len(h))
    if not size:
        return h
    n = len(h) - size + 1
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out += h[i : i + n] * PLACES[i]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(29)
    return np.unique(out)


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    out = np.full(len(FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), CHUNK):
        np.minimum(out, (FACTORS[:, None] * shingles[None, at : at + CHUNK] + SHIFTS[:, None]).min(axis=1), out=out)
    return out


def _class_of(words: list[bytes]) -> int:
    return xxhash.xxh3_64_intdigest(b" ".join(words)) - 2**63


def _marks(size: int):
    """The address, id, class, fingerprint, band keys and sketch of each row of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for block, rows in ((b, r) for batch in batches for b, r in zip(*batch.columns, strict=True)):
            own, prints, keys, bits = [], [], [], []
            for x in rows.values.field("_text"):
                words = words_of(x.as_py())
                own.append(_class_of(words))
                if words:
                    shingles = shingle_set(words, size)
                    least = min_hashes(shingles)
                    prints.append(simhash.majority(shingles))
                    keys.append([digest(band.tobytes(), i) - 2**63 for i, band in enumerate(least.reshape(BANDS, ROWS))])
                    bits.append(np.packbits((least >> np.uint64(20)).astype(np.uint8) & 1).view(np.int64))
                else:
                    prints.append(None), keys.append([]), bits.append(np.zeros(3, np.int64))
            prints = pa.array([None if p is None else p - 2**64 if p >= 2**63 else p for p in prints], pa.int64())
            sketch, n = np.array(bits, np.int64).reshape(-1, 3), len(own)
            address = [pa.array(np.full(n, block.as_py(), np.int64)), pa.array(np.arange(n, dtype=np.int32)), rows.values.field("_id")]
            yield pa.RecordBatch.from_arrays(
                [*address, pa.array(own, pa.int64()), prints, pa.array(keys, pa.list_(pa.int64())), *[pa.array(sketch[:, i].copy()) for i in range(3)]],
                ["_block", "_at", "_id", "_class", "_fp", "_bands", *SKETCH],
            )

    return run


def _sets(size: int):
    """The shingle sets of the wanted rows (_at, _class) of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, wanted in ((r, w) for batch in batches for r, w in zip(*batch.columns, strict=True)):
            texts, wanted = rows.values.field("_text"), wanted.as_py() or ()
            for i in range(0, len(wanted), 500):
                part = wanted[i : i + 500]
                sets = [shingle_set(words_of(texts[w["_at"]].as_py()), size).view(np.int64) for w in part]
                yield pa.RecordBatch.from_arrays([pa.array([w["_class"] for w in part], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["_class", "_set"])

    return run


def _taken(names: list[str]):
    """The rows of a block at the places (_keep)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, keep in ((r, k) for batch in batches for r, k in zip(*batch.columns, strict=True)):
            some = rows.values.take(pa.array(sorted(keep.as_py() or ()), pa.int32()))
            yield pa.RecordBatch.from_arrays([some.field(n) for n in names], names)

    return run


def _sketch_limit(similarity: float) -> int:
    n, p = BANDS * ROWS, (1 - similarity) / 2
    return math.ceil(n * p + 6 * math.sqrt(n * p * (1 - p)))


def _possible(a: str, b: str, similarity: float) -> Column:
    """Whether the sketches of two sides leave the similarity possible: a bit differs with half of what it lacks to 1."""
    differ = sum((F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))) for s in SKETCH[1:]), F.bit_count(F.col(f"{a}._s0").bitwiseXOR(F.col(f"{b}._s0"))))
    return differ <= _sketch_limit(similarity)


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Of ``pairs (_a, _b, _salt, _salts)`` those with the similarity. The sets of classes in many pairs are copied, so that
    no task gets all pairs of one class."""
    copies = pairs.groupBy(F.col("_a").alias("_class")).agg(F.max("_salts").alias("_salts"))
    a = sets.join(copies, "_class").select(F.col("_class").alias("_a"), F.col("_set").alias("_sa"), F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"))
    b = sets.select(F.col("_class").alias("_b"), F.col("_set").alias("_sb"))
    both = F.size(F.array_intersect("_sa", "_sb"))
    met = pairs.select("_a", "_b", "_salt").join(a, ["_a", "_salt"]).join(b, "_b")
    return met.filter(both >= F.lit(similarity) * (F.size("_sa") + F.size("_sb") - both) - 1e-9).select("_a", "_b")


def _salted(pairs: DataFrame, n: Column) -> DataFrame:
    """Distinct ``(_a, _b)`` with a salt, of one for so many pairs ``n`` of the same ``_a``."""
    salts = F.ceil(n / PER_SALT).cast("int")
    return pairs.groupBy("_a", "_b").agg(F.max(salts).alias("_salts")).withColumn("_salt", F.pmod(F.xxhash64("_b"), F.col("_salts").cast("long")).cast("int"))


def _bridges(limit: int, similarity: float):
    """Links between groups of two chunks of members, as few as join what the links join."""

    def run(key, t):
        i, j = key[-2].as_py(), key[-1].as_py()
        cls, chunk, group = (t.column(c).to_numpy() for c in ("_class", "_c", "_group"))
        group = group.copy()
        sketch = np.stack([t.column(s).to_numpy() for s in SKETCH], axis=1).view(np.uint64)
        flat = t.column("_set").combine_chunks()
        values, starts = flat.values.to_numpy().view(np.uint64), flat.offsets.to_numpy()
        length, places = np.diff(starts), np.arange(len(cls))
        pairs: list[tuple[int, int]] = []
        for a in places[chunk == i].tolist():
            rest = places[(chunk == j) & (group != group[a]) & (places > a if i == j else True)]
            rest = rest[np.bitwise_count(sketch[rest] ^ sketch[a]).sum(axis=1) <= limit]
            # Lengths further apart than the similarity allows need no look at the shingles.
            rest = rest[np.minimum(length[rest], length[a]) >= similarity * np.maximum(length[rest], length[a])]
            if len(rest):
                own = values[starts[a] : starts[a + 1]]
                other = np.concatenate([values[starts[b] : starts[b + 1]] for b in rest])
                at = np.minimum(np.searchsorted(own, other), len(own) - 1)
                both = np.add.reduceat((own[at] == other).astype(np.int64), np.concatenate([[0], np.cumsum(length[rest])[:-1]]))
                for b in rest[both >= similarity * (length[rest] + length[a] - both) - 1e-9].tolist():
                    if group[b] != group[a]:
                        pairs.append((a, b))
                        group[group == group[b]] = group[a]
        return pa.table({"_a": pa.array([cls[a] for a, _ in pairs], pa.int64()), "_b": pa.array([cls[b] for _, b in pairs], pa.int64())})

    return run


def _across(rows: DataFrame, groups: DataFrame, sets: DataFrame, similarity: float, hold=written) -> DataFrame:
    """``(_a, _b)``: links that join groups of members of one key, of ``rows (_key, _n, _class, sketch)``.

    A key's members are dealt into chunks of at most about ``CHUNK_ROWS`` members and ``CHUNK_SHINGLES`` shingles, and each
    pair of chunks is a task of its own.
    """
    grouped = rows.join(groups, "_class", "left").withColumn("_group", F.coalesce("_comp", "_class")).drop("_comp")
    several = grouped.groupBy("_key").agg((F.min("_group") < F.max("_group")).alias("_several")).filter("_several").select("_key")
    grouped = hold(grouped.join(several, "_key").join(sets, "_class"))
    load = grouped.groupBy("_key").agg(F.ceil(F.greatest(F.count("*") / CHUNK_ROWS, F.sum(F.size("_set")) / CHUNK_SHINGLES)).cast("int").alias("_chunks"))
    dealt = grouped.join(load, "_key").withColumn("_c", F.pmod(F.xxhash64("_class"), F.col("_chunks").cast("long")).cast("int"))
    each = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
    each = each.select("_key", F.least("_c", "_other").alias("_i"), F.greatest("_c", "_other").alias("_j"), "_class", "_c", "_group", *SKETCH, "_set")
    return each.groupBy("_key", "_i", "_j").applyInArrow(_bridges(_sketch_limit(similarity), similarity), "_a long, _b long")


def near_classes(marked: DataFrame, blocks: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """``marked (_block, _at, _id, _class, _fp, _bands, sketch)``: one row a class with ``_comp``, the smallest class reachable,
    and ``_first (id, block, place)`` of its row with the smallest id."""
    held: list[DataFrame] = []

    def hold(df: DataFrame) -> DataFrame:
        held.append(written(df))
        return held[-1]

    address = F.min(F.struct(F.col("_id").isNull().alias("_null"), "_id", "_block", "_at")).alias("_first")
    same = [F.first(c).alias(c) for c in ("_fp", "_bands", *SKETCH)]  # rows of a class have the same words
    classes = hold(marked.groupBy("_class").agg(address, *same))
    keys = classes.select("_class", F.explode("_bands").alias("_key"))
    member = F.xxhash64("_class")
    shared = keys.groupBy("_key").agg(F.count("*").alias("_n"), F.bit_xor(member).alias("_x"), F.min("_class").alias("_m"), F.max("_class").alias("_l"))
    shared = hold(shared.filter("_n > 1").groupBy("_n", "_x", "_m", "_l").agg(F.min("_key").alias("_key")).select("_key", "_n"))
    rows = hold(classes.select("_class", *SKETCH, F.explode("_bands").alias("_key")).join(shared, "_key"))
    # The closest copies by their fingerprints: a class of each fingerprint, and the other classes of the same one.
    prints = hold(classes.filter("_fp IS NOT NULL").groupBy("_fp").agg(F.min("_class").alias("_lead"), F.count("*").alias("_n")))
    lead = lambda fp, name: prints.select(F.col("_fp").alias(fp), F.col("_lead").alias(name))
    apart = simhash.links(prints).withColumnRenamed("_a", "_fa").withColumnRenamed("_b", "_fb").join(lead("_fa", "_a"), "_fa").join(lead("_fb", "_b"), "_fb")
    equal = classes.join(prints.filter("_n > 1"), "_fp").filter("_class <> _lead").select(F.col("_lead").alias("_a"), F.col("_class").alias("_b"), "_n")
    golay = apart.select(F.least("_a", "_b").alias("_a"), F.greatest("_a", "_b").alias("_b"), F.lit(1).cast("long").alias("_n")).union(equal)
    # Every member of a key with its leader.
    leaders = rows.groupBy("_key").agg(F.min(F.struct("_class", *SKETCH)).alias("_l")).select("_key", "_l.*")
    met = rows.alias("b").join(leaders.alias("a"), "_key").filter((F.col("a._class") != F.col("b._class")) & _possible("a", "b", similarity))
    met = met.select(F.col("a._class").alias("_a"), F.col("b._class").alias("_b"), "_n")
    first = hold(_salted(met.union(golay), F.col("_n")))
    # Whole shingle sets of the classes that may have a link, each from one row.
    wanted = rows.select("_class").union(first.select("_a")).union(first.select("_b")).distinct().join(classes.select("_class", "_first"), "_class")
    wanted = wanted.groupBy("_first._block").agg(F.collect_list(F.struct("_first._at", "_class")).alias("_wanted"))
    sets = hold(blocks.join(wanted.hint("shuffle_merge"), "_block").select("_rows", "_wanted").mapInArrow(_sets(size), "_class long, _set array<long>"))
    close = hold(_verified(first, sets, similarity))
    groups = components(close).withColumnRenamed("_node", "_class")
    more = _across(rows, groups, sets, similarity, hold)
    comp = components(close.union(more)).withColumnRenamed("_node", "_class")
    out = written(classes.select("_class", "_first").join(comp, "_class", "left").select("_class", "_first", F.coalesce("_comp", "_class").alias("_comp")))
    discard(*held)
    return out


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each group of ``docs``, that of the smallest id; columns stay as they are."""
    cols = docs.columns
    names = [f"_c{i}" for i in range(len(cols))]
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(cols, names, strict=True)], F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    blocks = row_blocks(rows, BLOCK_CHARS)
    sketch = "".join(f", {s} long" for s in SKETCH)
    marked = written(blocks.mapInArrow(_marks(size), f"_block long, _at int, _id long, _class long, _fp long, _bands array<long>{sketch}"))
    found = near_classes(marked, blocks, size, similarity)
    discard(marked)
    first = found.groupBy("_comp").agg(F.min("_first").alias("_first"))
    kept = first.groupBy("_first._block").agg(F.collect_list("_first._at").alias("_keep"))
    kinds = ", ".join(f"{n} {t}" for n, t in rows.dtypes[: len(cols)])
    out = blocks.join(kept.hint("shuffle_merge"), "_block").select("_rows", "_keep").mapInArrow(_taken(names), kinds)
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, cols, strict=True)])
