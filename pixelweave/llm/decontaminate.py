"""Benchmark decontamination: a prefix-filtered set join of item windows with documents, in DataFrame operations only.

A window is ``size`` consecutive words of an item (all of them if it has fewer). A document that contains a window holds
each of its words, so it is enough to look for one: the window's rarest word over all documents (the necessary prefix
at full containment is one token). Neighbouring windows mostly share that word, so an item of n words has far fewer than
n keys. A document word that is a key gives a candidate place; length and position bounds decide what could fit there;
the words to the left and right of it are compared with the item's, and the windows inside the agreeing stretch occur.

A key row carries the few item words around its place, never the item, so the key table grows in proportion to the items.
It is broadcast only if its measured size is at most ``max_broadcast`` bytes; beyond that the same rows are joined by a
shuffle, each key ``SALTS`` times, so that a common word's rows are dealt to many tasks. A candidate carries the few
words around it, never the document. Both ways find the same (the tests run both).

Defined cases: null texts have no words; items without words or with a null id never occur; rows of one item_id are one
item; repeated doc rows are separate rows; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelweave.llm.common import table, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs of ASCII letters, digits and all that is not ASCII.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

SALTS = 16


def lowered(word: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD), F.lit(0))


def window_keys(docs: DataFrame, benchmark: DataFrame, size: int, text_col: str, item_col: str, item_text: str, max_broadcast: int) -> DataFrame:
    """``_token, _item, _starts (of the windows keyed by it, counted from its place), _len, _iw (item words around it), _p (its
    place among these, from 0)``."""
    items = (
        benchmark.select(F.col(item_col).alias("_item"), F.transform(words(F.col(item_text)), lowered).alias("_iw"))
        .filter("_item IS NOT NULL AND size(_iw) > 0")
        .distinct()
        .withColumn("_no", F.monotonically_increasing_id())
    )
    items = written(items)
    vocabulary = written(items.select(F.explode("_iw").alias("_token")).distinct())
    bytes_ = vocabulary.agg(F.sum(F.octet_length("_token") + 32)).first()[0] or 0
    small = F.broadcast(vocabulary) if bytes_ <= max_broadcast else vocabulary
    spoken = docs.select(F.explode(words(F.col(text_col))).alias("_w")).select(lowered(F.col("_w")).alias("_token"))
    counts = written(spoken.join(small, "_token", "left_semi").groupBy("_token").count())
    placed = items.select("_no", "_item", F.size("_iw").alias("_n"), F.posexplode("_iw").alias("_at", "_token")).join(counts, "_token", "left")
    along, reach = Window.partitionBy("_no").orderBy("_at"), size - 1
    rarest = F.min(F.struct(F.coalesce("count", F.lit(0)).alias("f"), F.col("_token").alias("token"), F.col("_at").alias("at")))
    each = placed.select(
        "_no", "_item", "_n", "_at", rarest.over(along.rowsBetween(0, reach)).alias("_key"), F.collect_list("_token").over(along.rowsBetween(-reach, 2 * reach)).alias("_wide")
    ).filter(F.col("_at") <= F.greatest(F.lit(0), F.col("_n") - size))
    # Place of the key in the words around the window's start, then the words around the key alone.
    place = F.col("_key.at") - F.col("_at") + F.least("_at", F.lit(reach))
    first = F.greatest(place - reach, F.lit(0))
    around = F.struct(F.slice("_wide", first + 1, place + size - first).alias("iw"), (place - first).alias("p"))
    keyed = each.groupBy("_no", "_item", F.least("_n", F.lit(size)).alias("_len"), "_key.token", "_key.at").agg(
        F.sort_array(F.collect_list(F.col("_at") - F.col("_key.at"))).alias("_starts"), F.min(around).alias("_around")
    )
    return keyed.select(F.col("token").alias("_token"), "_item", "_starts", "_len", F.col("_around.iw").alias("_iw"), F.col("_around.p").alias("_p"))


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    size: int = 13,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    keep: tuple[str, ...] = (),
    max_broadcast: int = 32 << 20,
) -> DataFrame:
    """Per row of ``docs``: id, ``keep``, ``_n_words``, ``_n_hit``, ``_items`` (sorted item ids as strings)."""
    keys = written(window_keys(docs, benchmark, size, text_col, item_col, item_text, max_broadcast))
    bytes_ = keys.agg(F.sum(F.size("_iw") * 24 + F.size("_starts") * 8 + 64)).first()[0] or 0
    # The token '' stands for the document itself: with it every row of docs keeps exactly one row of its own.
    itself = docs.sparkSession.range(1).select(F.lit("").alias("_token"))
    cols = [id_col, *keep]
    held = [f"_c{i}" for i in range(len(cols))]
    base = docs.select(
        F.monotonically_increasing_id().alias("_row"), *[F.col(c).alias(h) for c, h in zip(cols, held, strict=True)], words(F.col(text_col)).alias("_w")
    )
    each = base.select("_row", *held, "_w", F.posexplode(F.concat(F.array(F.lit("")), F.col("_w"))).alias("_i", "_t"))
    n, each = F.size("_w"), each.withColumn("_token", lowered(F.col("_t")))
    first = F.greatest(F.col("_i") - size + 1, F.lit(1))
    # No row carries a whole document: what follows a match needs the words within a window's reach of it.
    near = [F.col("_row"), *map(F.col, held), F.col("_token"), F.col("_i"), n.alias("_n"), (F.col("_i") - first).alias("_at"), F.slice("_w", first, F.lit(2 * size - 1)).alias("_near")]
    if bytes_ <= max_broadcast:
        met = each.join(F.broadcast(keys.unionByName(itself, allowMissingColumns=True)), "_token").select(*near, "_item", "_iw", "_p", "_starts", "_len")
    else:
        salted = keys.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        spread = each.filter("_i > 0").select(*near, F.pmod(F.col("_row") + F.col("_i"), F.lit(SALTS)).cast("int").alias("_salt"))
        alone = each.filter("_i = 0").select(*near)
        met = spread.join(salted, ["_token", "_salt"]).drop("_salt").unionByName(alone, allowMissingColumns=True)
    # Length and place: the shortest stretch that the key's windows need must fit into the document here.
    last = F.col("_starts")[F.size("_starts") - 1]
    room = (F.col("_i") + last >= 1) & (F.col("_i") + F.col("_starts")[0] + F.col("_len") - 1 <= F.col("_n"))
    met = met.filter(F.col("_p").isNull() | room)

    def agreeing(sign: int) -> Column:
        same = F.transform(
            F.sequence(F.lit(1), F.lit(size - 1)),
            lambda k: F.coalesce(lowered(F.get("_near", F.col("_at") + sign * k)) == F.get("_iw", F.col("_p") + sign * k), F.lit(False)),
        )
        stop = F.array_position(same, False)
        return F.when(stop == 0, size - 1).otherwise(stop - 1)

    # Each step is a generator of at most one row, not a filter: a filter would move into the join and take it, and the
    # explosion of the words below it, out of generated code, where every word would carry its document.
    known = F.col("_p").isNotNull()
    reach = F.struct(F.when(known, agreeing(-1)).alias("left"), F.when(known, agreeing(1)).alias("right")) if size > 1 else F.struct(F.lit(0).alias("left"), F.lit(0).alias("right"))
    met = met.select("_row", *held, "_i", "_n", "_item", "_p", "_starts", "_len", F.explode(F.array(reach)).alias("_reach"))
    inside = F.filter("_starts", lambda s: (s >= -F.col("_reach.left")) & (s + F.col("_len") - 1 <= F.col("_reach.right")))
    met = met.select("_row", *held, "_i", "_n", "_item", "_p", "_len", F.explode(F.array(inside)).alias("_in"))
    span = F.struct(
        (F.col("_i") + F.col("_in")[0]).alias("a"),
        (F.col("_i") + F.col("_in")[F.size("_in") - 1] + F.col("_len") - 1).alias("b"),
    )
    none = F.lit(None).cast("struct<a:int,b:int>")
    spans = F.when(F.col("_p").isNull(), F.array(none)).when(F.size("_in") > 0, F.array(span)).otherwise(F.array().cast("array<struct<a:int,b:int>>"))
    found = met.select("_row", *held, F.col("_n").cast("long").alias("_n_words"), F.col("_item"), F.explode(spans).alias("_span"))
    per_row = found.groupBy("_row", *held, "_n_words").agg(
        F.sort_array(F.collect_set("_span")).alias("_spans"), F.array_sort(F.collect_set(F.col("_item").cast("string"))).alias("_items")
    )
    zero = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).alias("reach"))
    union = F.aggregate(
        "_spans",
        zero,
        lambda acc, s: F.struct(
            (acc["total"] + F.greatest(F.lit(0), s["b"] - F.greatest(acc["reach"], s["a"] - 1))).cast("long").alias("total"),
            F.greatest(acc["reach"], s["b"]).alias("reach"),
        ),
        lambda acc: acc["total"],
    )
    return per_row.select(*[F.col(h).alias(c) for h, c in zip(held, cols, strict=True)], "_n_words", union.alias("_n_hit"), "_items")


def is_contaminated() -> Column:
    """At least one word in twenty is hit."""
    return (F.col("_n_hit") > 0) & (20 * F.col("_n_hit") >= F.col("_n_words"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        F.col("_n_hit").alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ",").cast("binary"), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
    )


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, list_slice(w, s, s + least(13, len(w)) - 1) AS x
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS s FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
grams AS (SELECT doc_id, i, n, list_slice(w, i, i + n - 1) AS x FROM pos, lens WHERE i + n - 1 <= len(w)),
hit AS (SELECT g.doc_id, g.i, g.n, win.item_id FROM grams g JOIN win ON g.n = win.n AND g.x = win.x),
cover AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id)
"""
