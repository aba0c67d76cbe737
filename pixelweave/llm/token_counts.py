"""Token counts that follow edits: a segment tree of pre-token runs per document, kept with the document.

A text is cut into segments at places that no token and no normalisation reaches over, so token counts add up. The
segments are the leaves of a tree of (characters, tokens) sums, which ``with_trees`` stores beside the text. ``edited``
reads stored trees, never the whole text through the tokenizer: an edit (position, characters removed, text put in)
descends by lengths to the segments it touches, takes a neighbour as context where the seam is no longer a safe cut,
counts only that region again and updates the sums above it. Its result is stored in the same form, for the next edits.

Counting a region splits it into words and adds up the tokens of each; a task remembers the words it has counted, up to
``REMEMBER`` of them, also for later tasks of the same worker. Defined cases: null text is empty text; positions and
lengths beyond the text are cut to it; null edits and null fields of an edit do nothing (position 0, nothing removed,
nothing put in); edits apply in array order; repeated rows and null ids are kept row by row; a null tree is built.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.llm.bpe import SPACE, load_tokenizer, split_words, vocabulary_path
from pixelweave.llm.common import table, written

SEGMENT_CHARS = 160  # a segment ends at the first cut after so many characters
REMEMBER = 400_000
BLANK = re.compile(f"[{SPACE}]")
#: Where a text may be cut: before white space, or between an ASCII letter or digit and punctuation. No word of the tokenizer
#: and no composed character reaches over such a place; "|" is left out, as special tokens hold a letter before one.
CUT = re.compile(rf"[{SPACE}]|(?<=[A-Za-z0-9])[!-/:-@\[-`{{}}~]")
TREE = "struct<chars:array<int>,tokens:array<int>>"


class Counter:
    """Tokens of a text, word by word; each distinct word is encoded once until REMEMBER is reached."""

    def __init__(self, path: str):
        self.tok = load_tokenizer(path)
        self.known: dict[str, int] = {}

    def __call__(self, text: str) -> int:
        words, known = split_words(text), self.known
        try:
            return sum(map(known.__getitem__, words))
        except KeyError:
            pass
        new = [w for w in set(words) if w not in known]
        if new:
            if len(known) > REMEMBER:
                known.clear()
                new = list(set(words))
            known.update(zip(new, (len(e.ids) for e in self.tok.encode_batch(new, add_special_tokens=False)), strict=True))
        return sum(map(known.__getitem__, words))


@functools.lru_cache(1)
def counter(path: str) -> Counter:
    return Counter(path)


def safe_cut(before: str, after: str) -> bool:
    """Whether the seam of two texts is a place to cut: decided by the characters on either side of it."""
    return not before or not after or CUT.match(before[-1] + after[0], 1) is not None


def segments(text: str, segment_chars: int = SEGMENT_CHARS) -> list[str]:
    out, at = [], 0
    while at < len(text):
        m = CUT.search(text, at + segment_chars)
        end = m.start() if m else len(text)
        out.append(text[at:end])
        at = end
    return out or [""]


class SegmentTree:
    """Leaves are texts; ``chars`` and ``tokens`` are heaps of sums: node i has the children 2 i and 2 i + 1."""

    def __init__(self, text: str, count: Counter, segment_chars: int = SEGMENT_CHARS, stored: tuple[list[int], list[int]] | None = None):
        self.count, self.segment_chars, self.recounted = count, segment_chars, 0
        if stored:
            self.chars, self.tokens = stored
            self.size = len(self.chars) // 2
            ends = list(itertools.accumulate(self.chars[self.size :]))
            self.leaves = [text[b - n : b] for b, n in zip(ends, self.chars[self.size :], strict=True)]
        else:
            self.leaves = segments(text, segment_chars)
            self._build([count(leaf) for leaf in self.leaves])

    def _build(self, tokens: list[int]) -> None:
        self.size = 1 << (len(self.leaves) - 1).bit_length()
        rest = self.size - len(self.leaves)
        self.leaves += [""] * rest
        self.chars, self.tokens = [0] * self.size + list(map(len, self.leaves)), [0] * self.size + tokens + [0] * rest
        for sums in (self.chars, self.tokens):
            for i in range(self.size - 1, 0, -1):
                sums[i] = sums[2 * i] + sums[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def _find(self, pos: int) -> tuple[int, int]:
        """The leaf that holds character ``pos`` (the last non-empty one at the end) and the offset in it."""
        node = 1
        while node < self.size:
            left = self.chars[2 * node]
            if pos < left or not self.chars[2 * node + 1]:
                node = 2 * node
            else:
                node, pos = 2 * node + 1, pos - left
        return node - self.size, pos

    def _put(self, i: int, text: str, tokens: int) -> None:
        self.leaves[i] = text
        node = self.size + i
        chars, tokens = len(text) - self.chars[node], tokens - self.tokens[node]
        while node:
            self.chars[node] += chars
            self.tokens[node] += tokens
            node //= 2

    def edit(self, pos: int, n_del: int, ins: str) -> None:
        pos = max(0, min(pos, self.chars[1]))
        end = max(pos, min(pos + max(0, n_del), self.chars[1]))
        i, a = self._find(pos)
        j, _ = self._find(max(pos, end - 1))
        text = "".join(self.leaves[i : j + 1])
        text = text[:a] + ins + text[a + end - pos :]
        before, after = i - 1, j + 1
        while True:  # a neighbour comes in where the seam with it is no cut
            while before >= 0 and not self.leaves[before]:
                before -= 1
            while after < self.size and not self.leaves[after]:
                after += 1
            if before >= 0 and not safe_cut(self.leaves[before], text or (self.leaves[after] if after < self.size else "")):
                text, i, before = self.leaves[before] + text, before, before - 1
            elif after < self.size and not safe_cut(text, self.leaves[after]):
                text, j, after = text + self.leaves[after], after, after + 1
            else:
                break
        new = segments(text, self.segment_chars)
        tokens = [self.count(x) for x in new]
        self.recounted += len(text)
        if len(new) > j - i + 1:  # more segments than leaves: the sums are built again, from known counts
            rest = [k for k in range(len(self.leaves)) if self.leaves[k] and not i <= k <= j]
            kept = [(self.leaves[k], self.tokens[self.size + k]) for k in rest]
            cut = sum(k < i for k in rest)
            both = kept[:cut] + list(zip(new, tokens, strict=True)) + kept[cut:]
            self.leaves = [x for x, _ in both]
            self._build([n for _, n in both])
            return
        for k in range(i, j + 1):
            if k - i < len(new):
                self._put(k, new[k - i], tokens[k - i])
            elif self.leaves[k]:
                self._put(k, "", 0)

    def text(self) -> str:
        return "".join(self.leaves)


def _plant(path: str, n_cols: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, kind = counter(path), _tree_type()
        for batch in batches:
            trees = [SegmentTree(text.as_py() or "", count) for text in batch.column(n_cols)]
            column = pa.array([{"chars": t.chars, "tokens": t.tokens} for t in trees], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, "_tree"])

    return run


def _tree_type() -> pa.DataType:
    return pa.struct([("chars", pa.list_(pa.int32())), ("tokens", pa.list_(pa.int32()))])


def _edit(path: str, n_cols: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, kind = counter(path), _tree_type()
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for text, tree, edits in zip(*batch.columns[n_cols:], strict=True):
                tree, own = tree.as_py(), text.as_py() or ""
                tree = SegmentTree(own, count, stored=(tree["chars"], tree["tokens"]) if tree else None)
                before = tree.total
                for e in edits.as_py() or ():
                    if e:
                        tree.edit(e["pos"] or 0, e["n_del"] or 0, e["ins"] or "")
                row = tree.text(), {"chars": tree.chars, "tokens": tree.tokens}, before, tree.total, tree.recounted
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            arrays = [pa.array(x, k) for x, k in zip(out, (pa.string(), kind, pa.int64(), pa.int64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_cols], *arrays], [*batch.schema.names[:n_cols], *EDITED])

    return run


EDITS = "array<struct<pos:int,n_del:int,ins:string>>"
EDITED = ("_text", "_tree", "_before", "_after", "_recounted")


def with_trees(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str | None = None) -> DataFrame:
    """The ``keep`` columns, ``_text`` and ``_tree``: to be stored, and read by ``edited``."""
    base = docs.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(keep)], F.col(text_col).cast("string").alias("_text"))
    kinds = ", ".join(f"{n} {t}" for n, t in base.dtypes)
    out = base.mapInArrow(_plant(path or vocabulary_path(), len(keep)), f"{kinds}, _tree {TREE}")
    return out.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(keep)], "_text", "_tree")


def edited(stored: DataFrame, edits: str, keep: tuple[str, ...] = ("doc_id",), path: str | None = None) -> DataFrame:
    """Stored trees after the edits of column ``edits`` (array<struct<pos:int,n_del:int,ins:string>>): the ``keep`` columns,
    ``_text`` and ``_tree`` as edited, ``_before`` and ``_after`` (tokens), ``_recounted`` (characters counted again)."""
    base = stored.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(keep)], "_text", "_tree", F.col(edits).cast(EDITS).alias("_edits"))
    kinds = ", ".join(f"{n} {t}" for n, t in base.dtypes[: len(keep)])
    out = base.mapInArrow(_edit(path or vocabulary_path(), len(keep)), f"{kinds}, _text string, _tree {TREE}, _before long, _after long, _recounted long")
    return out.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(keep)], *EDITED)


def revised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` and ``_edits``: four edits of each text, taken from its own length and hash.

    A passage of the text is copied elsewhere, one is cut out, a few characters are overwritten, a line is added.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    n = F.char_length(text)
    place = lambda k: F.pmod(F.xxhash64(text, F.lit(k)), (n + 1).cast("long")).cast("int")
    edit = lambda pos, n_del, ins: F.struct(pos.alias("pos"), F.lit(n_del).alias("n_del"), ins.alias("ins"))
    return docs.withColumn(
        "_edits",
        F.array(
            edit(place(1), 0, F.substring(text, place(2) + 1, F.lit(60))),
            edit(place(3), 45, F.lit("")),
            edit(place(4), 4, F.lit("Tok3n's")),
            edit(n, 0, F.lit("\nRevised.")),
        ),
    )


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = written(with_trees(table(spark, sf_dir, "documents")))
    out = edited(revised(stored, text_col="_text"), "_edits")
    return out.select(
        "doc_id", F.col("_before").alias("n_tokens"), F.col("_after").alias("n_tokens_revised"), F.col("_recounted").alias("n_chars_recounted")
    )
