"""Toxicity by a weighted lexicon, matched with Aho-Corasick after folding.

Folding lower-cases, drops invisible characters, maps look-alike letters and digit substitutions to one form and turns
everything that is no letter into a space. The lexicon is learned: words and word beginnings (4 to 6 letters) that hold
a far larger share of toxic than of clean labelled rows, weighted by their log odds. Exception phrases are word pairs
around a lexicon word that clean rows hold and toxic rows don't; a match inside one does not count. The weights of a
text's matches are summed, divided by a power of its length, and mapped to 0..1 by a logistic curve fitted on the
same rows.

Training reads at most about ``max_labelled`` labelled rows, chosen by a hash (a documented bound); rows of the held-out
fold never take part. Scoring reads every whole text and nothing else. Null and empty texts score as texts without a
match. Repeated label rows count once, as toxic if any is; labels without a document and null labels are ignored.
Without any toxic label the lexicon is empty and every score is the same low value.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.llm.common import table, written

# Characters that stand for a Latin letter. l, 1 and | fold with i.
LOOKALIKES = {
    "a": "аα4@", "b": "вβ8", "c": "сϲ", "e": "еєε3", "g": "ɡ9", "h": "һ", "i": "іι1l|ıӏ", "j": "ј", "k": "кκ", "m": "м", "n": "ո", "o": "оοσ0օ",
    "p": "рρ", "q": "ԛ", "s": "ѕ5$", "t": "тτ7", "u": "υս", "v": "ѵν", "w": "ԝω", "x": "хχ", "y": "уγү", "z": "ʐ2",
}
INVISIBLE = "".join(map(chr, [0xAD, 0x34F, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0x335, 0x336, 0x337, 0x338]))

PREFIXES = (4, 5, 6)
SLICE_ROWS = 200


class _Folding(dict):
    """Code point to folded text; letters without an entry stay, all else becomes a space."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if not c.isalpha() and 0xFF01 <= code <= 0xFF5E:  # full-width forms
            c = chr(code - 0xFEE0)
        elif 0xFF21 <= code <= 0xFF5A:
            c = chr(code - 0xFEE0).lower()
        out = self.get(ord(c)) if ord(c) != code else None
        self[code] = out = out if out is not None else (c if c.isalpha() else " ")
        return out


def folding() -> dict[int, str]:
    out = _Folding({ord(c): "" for c in INVISIBLE})
    for letter, alikes in LOOKALIKES.items():
        out.update({ord(c): letter for c in alikes})
    return out


def fold(text: str, table_: dict[int, str]) -> str:
    return text.lower().translate(table_)


@dataclass
class Lexicon:
    weights: dict[str, float]  # " word " or " beginning"
    exceptions: tuple[str, ...] = ()  # " word word "
    power: float = 0.25
    bias: float = -4.0
    slope: float = 1.0

    def automaton(self) -> ahocorasick.Automaton | None:
        if not self.weights:
            return None
        out = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            out.add_word(term, (len(term), weight))
        for phrase in self.exceptions:
            out.add_word(phrase, (len(phrase), 0.0))
        out.make_automaton()
        return out

    def strength(self, text: str, auto: ahocorasick.Automaton | None, table_: dict[int, str]) -> float:
        """Sum of the best weight at each matched word, over a power of the number of words."""
        if auto is None:
            return 0.0
        folded = " " + " ".join(fold(text, table_).split()) + " "
        best: dict[int, float] = {}
        excused: list[tuple[int, int]] = []
        for end, (length, weight) in auto.iter(folded):
            start = end - length + 1
            if weight == 0.0:
                excused.append((start, end))
            elif weight > best.get(start, 0.0):
                best[start] = weight
        if excused:
            # Sorted by start, with the furthest end so far: a match is excused if that end lies behind it.
            excused.sort()
            starts, ends = [a for a, _ in excused], list(accumulate((b for _, b in excused), max))
            best = {s: w for s, w in best.items() if not (n := bisect_right(starts, s)) or ends[n - 1] <= s}
        return sum(best.values()) / max(1.0, folded.count(" ") - 1) ** self.power if best else 0.0

    def score(self, strength: float) -> float:
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, self.bias + self.slope * strength))))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table_ = folding()
    # Words and pairs take many times the bytes of their text: a batch is worked through in slices.
    for batch in (b.slice(at, SLICE_ROWS) for b in batches for at in range(0, b.num_rows, SLICE_ROWS)):
        words = [fold(x.as_py() or "", table_).split() for x in batch.column(1)]
        pairs = [sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)}) for w in words]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([xxhash.xxh3_64_intdigest(" ".join(w).encode("utf-8", "surrogatepass")) - 2**63 for w in words], pa.int64()),
                pa.array([sorted(set(w)) for w in words], pa.list_(pa.string())),
                pa.array(pairs, pa.list_(pa.string())),
            ],
            ["_toxic", "_like", "_words", "_pairs"],
        )


def _strengths(model: Lexicon, n_cols: int, score: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto, table_ = model.automaton(), folding()
        for batch in batches:
            found = [model.strength(x.as_py() or "", auto, table_) for x in batch.column(n_cols)]
            found = [model.score(x) for x in found] if score else found
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_cols], pa.array(found, pa.float64())], [*batch.schema.names[:n_cols], "_score"])

    return run


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Bias and slope by Newton steps on a lightly penalised likelihood."""
    w, design = np.zeros(2), np.stack([np.ones(len(x)), x], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -40, 40)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + 0.01 * np.eye(2), design.T @ (y - p) - 0.01 * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_labelled: int = 20_000,
    min_docs: int = 6,
    min_lift: float = 20.0,
) -> Lexicon:
    """The lexicon of the labelled rows: every term that ``min_docs`` distinct toxic texts hold, ``min_lift`` times as often
    as clean ones. Its size follows the labelled sample, of at most about ``max_labelled`` rows; no term is left out."""
    marks = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_toxic")).dropna()
    marks = marks.filter(~held_out(F.col("_id"))).groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
    total = marks.count()
    if total > max_labelled:
        marks = marks.filter(F.pmod(F.xxhash64("_id"), F.lit(2**53)) < int(2**53 * max_labelled / total))
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    # The sample is bounded by max_labelled (16 bytes a row), so its ids may be sent to every task.
    rows = written(texts.join(F.broadcast(marks), "_id").select("_toxic", "_text"))
    # Copies of a text count once: rows with the same hash of the whole folded text are copies.
    read = written(rows.mapInArrow(_words, "_toxic int, _like long, _words array<string>, _pairs array<string>"))
    n = {r[0]: r[1] for r in read.groupBy("_toxic").agg(F.count_distinct("_like")).collect()}
    nt, nc = n.get(1, 0), n.get(0, 0)
    if not nt:
        return Lexicon({})
    terms = F.flatten(
        F.transform("_words", lambda w: F.concat(F.array(F.concat(F.lit(" "), w, F.lit(" "))), *[F.when(F.char_length(w) >= k, F.array(F.concat(F.lit(" "), F.substring(w, 1, k)))).otherwise(F.array().cast("array<string>")) for k in PREFIXES]))
    )
    each = read.select("_toxic", "_like", F.explode(F.array_distinct(terms)).alias("_term"))
    toxic = each.filter("_toxic = 1").groupBy("_term").agg(F.count_distinct("_like").alias("_t")).filter(F.col("_t") >= min_docs)
    toxic = written(toxic)
    clean = each.filter("_toxic = 0").join(toxic.select("_term"), "_term").groupBy("_term").agg(F.count_distinct("_like").alias("_c"))
    odds = F.log((F.col("_t") + 0.5) / (nt + 1)) - F.log((F.col("_c") + 0.5) / (nc + 1))
    found = (
        toxic.join(clean, "_term", "left")
        .withColumn("_c", F.coalesce("_c", F.lit(0)))
        .withColumn("_w", odds)
        .filter((F.col("_w") >= math.log(min_lift)) & (F.col("_t") >= 2 * F.col("_c")))
        .collect()
    )
    weights = {r["_term"]: float(r["_w"]) for r in found}
    model = Lexicon(weights, _exceptions(read, sorted({t.strip() for t in weights if t.endswith(" ")})))
    marked = rows.mapInArrow(_strengths(model, 1, False), "_toxic int, _score double").collect() if weights else []
    if marked:
        x, y = np.array([r["_score"] for r in marked]), np.array([float(r["_toxic"] == 1) for r in marked])
        model.bias, model.slope = _logistic(x, y)
    return model


def _exceptions(read: DataFrame, words: list[str], min_clean: int = 3) -> tuple[str, ...]:
    """Word pairs with a lexicon word in them that several clean texts hold and no toxic one."""
    if not words:
        return ()
    # The lexicon goes to every task anyway, as part of the model.
    listed = read.sparkSession.createDataFrame([(w,) for w in words], "_word string")
    pairs = read.select("_toxic", "_like", F.explode("_pairs").alias("_pair"))
    ends = F.array(F.substring_index("_pair", " ", 1), F.substring_index("_pair", " ", -1))
    either = pairs.select("*", F.explode(ends).alias("_word")).join(F.broadcast(listed), "_word", "left_semi")
    counts = either.groupBy("_pair").agg(F.max("_toxic").alias("_t"), F.count_distinct("_like").alias("_n"))
    rows = counts.filter((F.col("_t") == 0) & (F.col("_n") >= min_clean)).collect()
    return tuple(sorted(f" {r['_pair']} " for r in rows))


def scored(docs: DataFrame, model: Lexicon, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns and ``_score``."""
    base = docs.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(keep)], F.col(text_col).cast("string").alias("_text"))
    kinds = ", ".join(f"{n} {t}" for n, t in base.dtypes[: len(keep)])
    out = base.mapInArrow(_strengths(model, len(keep), True), f"{kinds}, _score double")
    return out.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(keep)], "_score")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = scored(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.3).cast("int").alias("predicted")
    )
