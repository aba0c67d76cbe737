"""Ranked lexical search: dense products of document impact tiles and item vocabulary tiles, in float64 and exact.

1. Documents become counts of the items' terms: one pass over the texts, one narrow row a document. Documents and terms are
   counted over all of them (N, L, df).
2. Items are packed into tiles with at most ``TILE_TERMS`` terms, numbered compactly; a longer item is a tile of its own in
   several such parts. A part is a dense matrix (terms x items) of weights.
3. Each batch of documents becomes, for each part, a dense matrix (documents x terms) of impacts, and one matrix product
   gives all scores. An impact is at most 10**6 and a weight less than 43,700, so the sum over ``TILE_TERMS`` terms stays
   below 2**47 and every partial sum is an exact whole number in float64; parts are added as integers.
4. A task keeps the ``k`` best documents of each item, all that are tied with the last one taken into account; Spark ranks
   what the tasks keep.

The items are the stated queries: they meet all documents in blocks. Their terms go to the tasks by broadcast in groups of
at most ``GROUP_BYTES`` of text (checked; a larger table of items takes more groups, each a pass over the documents).

Defined cases: null texts have no terms; an item without terms has no rows; every row of the items is an item of its own,
repeated ids included, and every row of the documents a document; null ids come last among equal scores; empty tables give
an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelweave.llm.common import discard, table, written

TILE_TERMS, TILE_ITEMS, TILE_DOCS = 2_048, 64, 1_024
GROUP_BYTES = 16_000_000
SLICE = 1 << 20
# Bytes of UTF-8: 0-9, A-Z as a-z, a-z and everything beyond ASCII are kept, the others separate terms.
KEPT = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def term_counts(text: str | None) -> Counter[bytes]:
    """Terms of a text with their number, slice by slice."""
    data, out, at = (text or "").encode().translate(KEPT), Counter(), 0
    while at < len(data):
        end = data.find(b" ", at + SLICE)
        end = len(data) if end < 0 else end
        out.update(data[at:end].split())
        at = end
    return out


def _count(number: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, terms, times = [], [], []
            for text in batch.column(1):
                counts = term_counts(text.as_py())
                total.append(sum(counts.values()))
                own = sorted((number[t], c) for t, c in counts.items() if t in number)
                terms.append([i for i, _ in own])
                times.append([c for _, c in own])
            columns = [batch.column(0), pa.array(total, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["_doc", "_n", "_terms", "_times"])

    return run


@dataclass
class Part:
    """A matrix of weights: the numbers of its terms, ascending, and a row for each of them."""

    terms: np.ndarray
    weights: np.ndarray


@dataclass
class Tile:
    items: list[int]
    parts: list[Part]


def tiles(items: list[list[int]], weight: np.ndarray) -> list[Tile]:
    """Items (lists of term numbers) packed in order, so that a tile's terms fit one part; a longer item is cut into parts."""

    def tile(members: list[int], terms: set[int]) -> Tile:
        every, parts = np.array(sorted(terms), np.int64), []
        for at in range(0, len(every), TILE_TERMS):
            own = every[at : at + TILE_TERMS]
            w = np.zeros((len(own), len(members)))
            for j, i in enumerate(members):
                mine = np.intersect1d(own, np.array(items[i], np.int64))
                w[np.searchsorted(own, mine), j] = weight[mine]
            parts.append(Part(own, w))
        return Tile(members, parts)

    out: list[Tile] = []
    members: list[int] = []
    terms: set[int] = set()
    for i, own in enumerate(items):
        if not own:
            continue
        if members and (len(members) == TILE_ITEMS or len(terms | set(own)) > TILE_TERMS):
            out.append(tile(members, terms))
            members, terms = [], set()
        members.append(i)
        terms |= set(own)
    return [*out, tile(members, terms)] if members else out


def best(score: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` highest scores above 0 with their documents, ties by document: every score equal to the k-th is compared."""
    own = np.flatnonzero(score > 0)
    if len(own) > k:
        least = np.partition(score[own], len(own) - k)[len(own) - k]
        own = own[score[own] >= least]
    own = own[np.lexsort((doc[own], -score[own]))][:k]
    return score[own], doc[own]


def _score(made: list[Tile], terms_in_all: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = np.full(terms_in_all, -1, np.int64)
        top: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, TILE_DOCS):
                rows = batch.slice(at, TILE_DOCS)
                times = rows.column(3)
                place = np.repeat(np.arange(rows.num_rows), np.diff(times.offsets.to_numpy()))
                tf, terms = times.flatten().to_numpy(), rows.column(2).flatten().to_numpy()
                m = rows.column(1).to_numpy()[place]
                impact = (1_000_000_000 * tf) // (1_000 * tf + 8 * m)
                doc = rows.column(0).fill_null(2**63 - 1).to_numpy()
                for t in made:
                    score = np.zeros((rows.num_rows, len(t.items)), np.int64)
                    for p in t.parts:
                        local[p.terms] = np.arange(len(p.terms))
                        col = local[terms]
                        met = col >= 0
                        local[p.terms] = -1
                        x = np.zeros((rows.num_rows, len(p.terms)))
                        x[place[met], col[met]] = impact[met]
                        score += (x @ p.weights).astype(np.int64)
                    for j, i in enumerate(t.items):
                        s, d = score[:, j], doc
                        if i in top:
                            s, d = np.concatenate([top[i][0], s]), np.concatenate([top[i][1], d])
                        top[i] = best(s, d, k)
        if top:
            which = np.concatenate([np.full(len(s), i, np.int32) for i, (s, _) in top.items()])
            doc = np.concatenate([d for _, d in top.values()])
            score = np.concatenate([s for s, _ in top.values()])
            yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(doc, mask=doc == 2**63 - 1), pa.array(score)], ["_item", "_doc", "_score"])

    return run


def search_group(docs: DataFrame, items: list[str | None], k: int) -> DataFrame:
    """``(_item, _doc, _score)``: the ``k`` best documents of ``docs (_doc long, _text)`` for each text of a list whose size
    has been checked, by its place in the list, from each task."""
    lists = [sorted(term_counts(x)) for x in items]
    number = {t: i for i, t in enumerate(sorted({t for x in lists for t in x}))}
    counts = written(docs.mapInArrow(_count(number), "_doc long, _n long, _terms array<int>, _times array<long>").filter("_n > 0"))
    n, words = counts.agg(F.count("*"), F.sum("_n")).first()
    df = np.zeros(max(1, len(number)), np.int64)
    for i, found in counts.select(F.explode("_terms").alias("_t")).groupBy("_t").count().collect():  # a row a term of the items
        df[i] = found
    weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    made = tiles([[number[t] for t in x] for x in lists], weight)
    if not made or not n:
        discard(counts)
        return docs.sparkSession.createDataFrame([], "_item int, _doc long, _score long")
    length = (F.lit(10) + F.expr(f"(90BD * _n * {n}BD) div {words}BD")).cast("long")  # decimal: the product may pass 64 bits
    found = counts.select("_doc", length.alias("_m"), "_terms", "_times").filter(F.size("_terms") > 0)
    out = written(found.mapInArrow(_score(made, len(number), k), "_item int, _doc long, _score long"))
    discard(counts)
    return out


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text") -> DataFrame:
    """Each item's ``k`` highest-scoring documents: ``_item`` (its id), ``_rank`` from 1, ``_doc``, ``_score``."""
    spark = docs.sparkSession
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("_doc"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    asked = items.select(F.col(f"`{item_col}`").alias("_id"), F.col(f"`{query_col}`").cast("string").alias("_text"))
    asked = written(asked.withColumn("_row", F.monotonically_increasing_id()))
    out = None
    for group in groups(asked):
        batch = group.select("_row", "_text").orderBy("_row").collect()
        found = search_group(texts, [text for _, text in batch], k)
        rows = spark.createDataFrame([(i, row) for i, (row, _) in enumerate(batch)], "_item int, _row long")
        found = found.join(rows, "_item").select("_row", "_doc", "_score")
        out = found if out is None else out.union(found)
    order = Window.partitionBy("_row").orderBy(F.desc("_score"), F.asc_nulls_last("_doc"))
    ranked = out.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= k)
    return ranked.join(asked.select("_row", F.col("_id").alias("_item")), "_row").select("_item", "_rank", "_doc", "_score")


def groups(asked: DataFrame, most: int = GROUP_BYTES) -> list[DataFrame]:
    """``asked (_row, _text)`` in groups of at most ``most`` bytes of text; a longer text is a group of its own."""
    size = F.coalesce(F.octet_length("_text"), F.lit(0)).cast("long")
    total, n = asked.agg(F.coalesce(F.sum(size), F.lit(0)), F.count("*")).first()
    parts = max(1, -(-2 * total // most)) if total > most else 1
    while True:
        of = F.pmod(F.xxhash64("_row"), F.lit(parts))
        largest = asked.groupBy(of.alias("_g")).agg(F.sum(size).alias("_size"), F.count("*").alias("_k")).filter((F.col("_size") > most) & (F.col("_k") > 1))
        if parts == 1 and total <= most or largest.isEmpty():
            return [asked.filter(of == g) for g in range(parts)]
        parts *= 2


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(F.col("_item").alias("item_id"), F.col("_rank").alias("rank"), F.col("_doc").alias("doc_id"), F.col("_score").alias("score"))


OP13_SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
d AS (SELECT r, doc_id, w, len(w) AS n FROM t WHERE len(w) > 0),
g AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS l FROM d),
c AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY 1, 2),
q AS (SELECT row_number() OVER () AS i, item_id, list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM benchmark),
x AS (SELECT i, item_id, unnest(w) AS term FROM q),
f AS (SELECT term, CAST(floor(1000e0 * ln(CAST(2 * any_value(nn) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS weight FROM c, g GROUP BY term),
s AS (SELECT x.i, x.item_id, d.doc_id, c.r, CAST(sum(f.weight * ((1000000000 * c.tf) // (1000 * c.tf + 8 * (10 + (90 * d.n * g.nn) // g.l)))) AS BIGINT) AS score
      FROM x JOIN f ON x.term = f.term JOIN c ON x.term = c.term JOIN d ON c.r = d.r, g GROUP BY 1, 2, 3, 4),
k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM k WHERE rank <= 10
"""
