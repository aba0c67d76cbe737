"""Prefix trie of conversations: how much of their turns is shared, node by node.

1. Turns are encoded by a dictionary: the 128-bit hash of (role, text) has one integer id. Texts are read once and never
   shuffled; a conversation is a row with the array of its turns' ids.
2. Equal conversations become one row with their number, smallest id and the digest of their ids. The ids of a hot
   conversation are sorted in several tasks and joined in chunks; the digest runs through the chunks in order.
3. Distinct conversations are dealt out by ranges of their id sequences. Each range shard builds a ternary search tree over
   turn ids, inserting medians first so that it is balanced, and sums members, children, leaves and savings from the deepest
   nodes up, without recursion.
4. A node that other shards may hold too lies on the path of the shard's first or last conversation. Those two paths go,
   with what hangs below them summed up, to the shards of the next level as sequences of their own, until one shard is left.

Defined cases: rows without a conversation id belong to none and are left out; turns are ordered by ``turn``, null first,
and equal ones by the hash of role and text; null role or text is empty; repeated rows are turns of their own; an empty
table gives an empty result. A conversation is one row of 8 bytes and a length a turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.llm.common import discard, shuffle_partitions, table, written

SHARD_IDS = 500_000
CHUNK_IDS = 65_536
NO_ONE = 2**63 - 1
RECORD = "array<struct<depth:long,n:long,least:long,kids:long,leaves:long,saved:long,ends:string>>"
ITEM = f"_seq array<long>, _lens array<long>, _at {RECORD}"
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def turn_hash(role: Column, text: Column) -> Column:
    return F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))


def encoded(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(_c long, _seq array<long>, _lens array<long>)``, a row a conversation: ids and code points of its turns in order."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    turns = rows.filter(F.col(f"`{conv_col}`").isNotNull()).select(
        F.col(f"`{conv_col}`").cast("long").alias("_c"),
        F.col(f"`{turn_col}`").alias("_turn"),
        F.unhex(turn_hash(role, text)).alias("_m"),
        F.char_length(text).cast("long").alias("_n"),
    )
    turns = written(turns)
    ids = written(turns.select("_m").distinct().withColumn("_id", F.monotonically_increasing_id()))
    all_ = turns.join(ids, "_m").groupBy("_c").agg(F.sort_array(F.collect_list(F.struct("_turn", "_m", "_id", "_n"))).alias("_t"))
    out = written(all_.select("_c", F.col("_t._id").alias("_seq"), F.col("_t._n").alias("_lens")))
    discard(turns, ids)
    return out


def rebuilt(convs: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """Conversations whose first h turns are those of conversation ``c - c % every``; h is crc32 of c modulo ``most``."""
    names = ("_seq", "_lens")
    base = F.col("_c") - F.col("_c") % every
    heads = convs.filter(F.col("_c") % every == 0).select(F.col("_c").alias("_base"), *[F.slice(n, 1, most - 1).alias(f"{n}_head") for n in names])
    h = (F.crc32(F.col("_c").cast("string").cast("binary")) % most).cast("int")
    head = lambda n: F.slice(F.coalesce(f"{n}_head", F.array().cast("array<long>")), F.lit(1), h)
    own = lambda n: F.slice(n, h + 1, F.greatest(F.size(n), F.lit(1)))
    return convs.join(heads, base == F.col("_base"), "left").select("_c", *[F.concat(head(n), own(n)).alias(n) for n in names])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ``(_k, _c)`` to one row a key and CHUNK_IDS ids: key, first id, number, ids joined by commas."""
    out: list[tuple[bytes, int, int, str]] = []
    key, held = None, []

    def close() -> None:
        if held:
            out.append((key, held[0], len(held), ",".join(map(str, held))))
            held.clear()

    def rows() -> pa.RecordBatch:
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.string())
        batch = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], ["_k", "_first", "_n", "_ids"])
        out.clear()
        return batch

    for batch in batches:
        for k, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if k != key or len(held) == CHUNK_IDS:
                close()
                key = k
            held.append(c)
        if len(out) >= 1_000:
            yield rows()
    close()
    if out:
        yield rows()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks sorted by key and first id to one row a key: number, smallest id, digest of all ids joined by commas."""
    key, n, first, state = None, 0, 0, None
    for batch in batches:
        out: list[tuple[bytes, int, int, str]] = []
        for k, c, m, ids in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if k == key:
                state.update(b"," + ids.encode())
                n += m
                continue
            if state is not None:
                out.append((key, n, first, state.hexdigest()))
            key, n, first, state = k, m, c, hashlib.sha256(ids.encode())
        if out:
            yield _digest_rows(out)
    if state is not None:
        yield _digest_rows([(key, n, first, state.hexdigest())])


def _digest_rows(out: list[tuple[bytes, int, int, str]]) -> pa.RecordBatch:
    kinds = (pa.binary(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], ["_k", "_count", "_least", "_ends"])


def distinct(convs: DataFrame) -> DataFrame:
    """``_seq, _lens, _at``: distinct sequences, each with one record at its end."""
    spark = convs.sparkSession
    keyed = written(convs.withColumn("_k", F.unhex(F.md5(F.concat_ws(",", F.col("_seq").cast("array<string>")).cast("binary")))))
    ids = keyed.select("_k", "_c").repartitionByRange(shuffle_partitions(spark), "_k", "_c").sortWithinPartitions("_k", "_c")
    chunks = ids.mapInArrow(_chunks, "_k binary, _first long, _n long, _ids string").repartition("_k").sortWithinPartitions("_k", "_first")
    ends = chunks.mapInArrow(_digests, "_k binary, _count long, _least long, _ends string")
    one = keyed.groupBy("_k").agg(F.first("_seq").alias("_seq"), F.first("_lens").alias("_lens"))
    zero = F.lit(0).cast("long")
    names = ("depth", "n", "least", "kids", "leaves", "saved", "ends")
    values = (F.size("_seq").cast("long"), F.col("_count"), F.col("_least"), zero, zero, zero, F.col("_ends"))
    out = written(one.join(ends, "_k").select("_seq", "_lens", F.array(F.struct(*[v.alias(n) for v, n in zip(values, names, strict=True)])).alias("_at")))
    discard(keyed)
    return out


class TernaryTree:
    """Nodes in parallel lists, parents before children; node 0 is the root. ``lo`` and ``hi`` lead to siblings with smaller
    and larger ids, ``eq`` to the children."""

    def __init__(self) -> None:
        self.id, self.lo, self.eq, self.hi = [0], [-1], [-1], [-1]
        self.parent, self.depth, self.len = [-1], [0], [0]
        self.n, self.least, self.kids, self.leaves, self.saved = [0], [NO_ONE], [0], [0], [0]
        self.ends: list[str | None] = [None]

    def _add(self, key: int, parent: int, length: int) -> int:
        for column, value in (
            (self.id, key), (self.lo, -1), (self.eq, -1), (self.hi, -1), (self.parent, parent), (self.depth, self.depth[parent] + 1),
            (self.len, length), (self.n, 0), (self.least, NO_ONE), (self.kids, 0), (self.leaves, 0), (self.saved, 0), (self.ends, None),
        ):
            column.append(value)
        return len(self.id) - 1

    def insert(self, seq: list[int], lens: list[int]) -> list[int]:
        """The nodes of the path, the root first."""
        path = [0]
        for key, length in zip(seq, lens, strict=True):
            top = path[-1]
            at = self.eq[top]
            if at < 0:
                at = self.eq[top] = self._add(key, top, length)
            while self.id[at] != key:
                side = self.lo if key < self.id[at] else self.hi
                if side[at] < 0:
                    side[at] = self._add(key, top, length)
                at = side[at]
            path.append(at)
        return path

    def insert_all(self, items: list[tuple]) -> tuple[list[int], list[int]]:
        """Insert sorted items, the median of each range first; the paths of the first and the last one."""
        ranges, ends = [(0, len(items))], {}
        while ranges:
            low, high = ranges.pop()
            mid = (low + high) // 2
            seq, lens, records = items[mid]
            path = self.insert(seq, lens)
            for r in records:
                v = path[r["depth"]]
                self.n[v] += r["n"]
                self.least[v] = min(self.least[v], r["least"])
                self.kids[v] += r["kids"]
                self.leaves[v] += r["leaves"]
                self.saved[v] += r["saved"]
                self.ends[v] = r["ends"] or self.ends[v]
            if mid in (0, len(items) - 1):
                ends[mid] = path
            ranges += [x for x in ((low, mid), (mid + 1, high)) if x[0] < x[1]]
        return ends[0], ends[len(items) - 1]

    def sum_up(self, open_: set[int]) -> None:
        """Add each node that is not open to its parent, the deepest first."""
        for v in range(len(self.id) - 1, -1, -1):
            if v in open_:
                continue
            self.leaves[v] += not self.kids[v]
            self.saved[v] += (self.n[v] - 1) * self.len[v]
            p = self.parent[v]
            if p >= 0:
                self.n[p] += self.n[v]
                self.least[p] = min(self.least[p], self.least[v])
                self.kids[p] += 1
                self.leaves[p] += self.leaves[v]
                self.saved[p] += self.saved[v]

    def record(self, v: int) -> dict:
        return {"depth": self.depth[v], "n": self.n[v], "least": self.least[v], "kids": self.kids[v], "leaves": self.leaves[v], "saved": self.saved[v], "ends": self.ends[v]}

    def path_key(self, v: int, known: dict[int, bytes]) -> bytes:
        """128 bits that stand for the sequence of ids down to ``v``."""
        below = []
        while v not in known:
            below.append(v)
            v = self.parent[v]
        key = known[v]
        for v in reversed(below):
            key = known[v] = xxhash.xxh3_128_digest(key + self.id[v].to_bytes(8, "little", signed=True))
        return key


KINDS = (*[pa.int64()] * 7, pa.string(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), None)
OUT = f"{NODE}, _key binary, _up binary, {ITEM}"
NAMES = [x.split()[0] for x in NODE.split(", ")] + ["_key", "_up", "_seq", "_lens", "_at"]


def _shard(last: bool, above: bool):
    """A sorted range of items to the nodes that are complete (``_seq`` NULL) and, unless it is the last shard of all, the
    items of its open paths. The nodes of a level above the first were open below: others name them as parents by their key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, kind = [], None
        for batch in batches:
            kind = batch.schema.field(2).type
            items += zip(*(x.to_pylist() for x in batch.columns), strict=True)
        if not items:
            return
        tree = TernaryTree()
        first, final = tree.insert_all(items)
        open_ = set() if last else {*first, *final}
        tree.sum_up(open_)
        known, out = {0: b""}, []

        def rows() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(x, t or kind) for x, t in zip(zip(*out, strict=True), KINDS, strict=True)], NAMES)
            out.clear()
            return batch

        for v in range(len(tree.id)):
            if v in open_:
                continue
            p = tree.parent[v]
            up = tree.path_key(p, known) if p in open_ else None
            least = tree.least[p] if p >= 0 and p not in open_ else None
            own = tree.path_key(v, known) if above else None
            out.append((tree.least[v], tree.depth[v], least, tree.n[v], tree.kids[v], tree.leaves[v], tree.saved[v], tree.ends[v], own, up, None, None, None))
            if len(out) >= 20_000:
                yield rows()
        if not last:
            seen: set[int] = set()
            for path, (seq, lens, _) in {len(items) - 1: (final, items[-1]), 0: (first, items[0])}.values():
                new = [v for v in path if v not in seen]
                seen.update(new)
                out.append((*[None] * 10, seq, lens, [tree.record(v) for v in new]))
        if out:
            yield rows()

    return run


def trie(convs: DataFrame) -> DataFrame:
    """The nodes of the trie of ``convs (_c, _seq, _lens)``, in the columns ``NODE``."""
    spark, items = convs.sparkSession, distinct(convs)
    levels: list[DataFrame] = []
    while True:
        n, ids = items.agg(F.count("*"), F.coalesce(F.sum(F.size("_seq") + 1), F.lit(0))).first()
        wide = min(max(-(-ids // SHARD_IDS), min(shuffle_partitions(spark), ids // 5_000)), n // 8)
        dealt = items.repartitionByRange(wide, "_seq") if wide > 1 else items.coalesce(1)
        levels.append(written(dealt.sortWithinPartitions("_seq").mapInArrow(_shard(wide <= 1, bool(levels)), OUT)))
        if wide <= 1:
            break
        items = levels[-1].filter("_seq IS NOT NULL").select("_seq", "_lens", "_at")
    nodes = levels[0].filter("_seq IS NULL")
    for more in levels[1:]:
        nodes = nodes.union(more.filter("_seq IS NULL"))
    done = nodes.filter("_up IS NULL").select(*NAMES[:8])
    if len(levels) > 1:
        tops = nodes.filter("_key IS NOT NULL").select("_key", F.col("conv_id").alias("_top"))
        hung = nodes.filter("_up IS NOT NULL").drop("_key").join(tops, F.col("_up") == F.col("_key"))
        done = done.union(hung.select("conv_id", "depth", F.col("_top").alias("parent_conv_id"), *NAMES[3:8]))
    return done.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(rebuilt(encoded(table(spark, sf_dir, "conversations"))))


OP12_SQL = r"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS m,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn ASC NULLS FIRST,
           md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT DISTINCT c, c - c % 100 AS b, CAST(c AS VARCHAR) AS s FROM t),
h AS (SELECT c, b, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(s) + 1), lambda j: ascii(substr(s, j, 1))::BIGINT)),
        lambda x, y: list_reduce(list_prepend(xor(x, y), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda u, v: xor(u >> 1, 3988292384::BIGINT * (u & 1)))), 4294967295::BIGINT) % 6 AS h FROM k),
r AS (SELECT h.c, t.m, t.text, t.i FROM h JOIN t ON t.c = h.b AND t.i <= h.h
      UNION ALL SELECT h.c, t.m, t.text, 1000000 + t.i FROM h JOIN t ON t.c = h.c AND t.i > h.h),
q AS (SELECT c, m, text, row_number() OVER (PARTITION BY c ORDER BY i) AS d FROM r),
p AS (SELECT c, d, length(text) AS len, string_agg(m, '') OVER (PARTITION BY c ORDER BY d) AS key FROM q UNION ALL SELECT c, 0, 0, '' FROM h),
z AS (SELECT c, max(d) AS last FROM p GROUP BY c),
n AS (SELECT key, d, min(p.c) AS c, count(*) AS n_convs, max(len) AS len,
        sha256(coalesce(string_agg(CAST(p.c AS VARCHAR), ',' ORDER BY p.c) FILTER (last = d), '')) AS ends FROM p JOIN z ON p.c = z.c GROUP BY key, d),
x AS (SELECT p.c AS own, p.d, n.c, n.n_convs, n.len, n.ends FROM p JOIN n ON p.key = n.key AND p.d = n.d),
y AS (SELECT n.c, n.d, u.c AS parent, count(w.c) AS kids FROM n LEFT JOIN x u ON u.own = n.c AND u.d = n.d - 1
      LEFT JOIN (SELECT a.c, a.d, b.c AS top FROM n a JOIN x b ON b.own = a.c AND b.d = a.d - 1) w ON w.top = n.c AND w.d = n.d + 1 GROUP BY 1, 2, 3),
s AS (SELECT u.c, u.d, count(*) FILTER (y.kids = 0) AS leaves, sum((n.n_convs - 1) * n.len) AS saved
      FROM n JOIN y ON n.c = y.c AND n.d = y.d JOIN x u ON u.own = n.c AND u.d <= n.d GROUP BY 1, 2)
SELECT n.c AS conv_id, CAST(n.d AS BIGINT) AS depth, y.parent AS parent_conv_id, n.n_convs, CAST(y.kids AS BIGINT) AS n_children,
       CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, n.ends AS ends_sha256
FROM n JOIN y ON n.c = y.c AND n.d = y.d JOIN s ON n.c = s.c AND n.d = s.d
"""
