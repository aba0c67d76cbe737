"""BPE encoding and decoding through a table of distinct words.

1. ``word_blocks``: each task cuts its documents into blocks of bounded size, splits their texts into words, and writes
   for each block its distinct words and, per document, the positions as codes into them (compressed). Texts go no
   further. The table is bucketed by block, so what comes back later meets it without moving it again.
2. The (word, address) rows of all blocks are dealt by word and sorted, so that each distinct word is one run: it is
   encoded once, and the run's ids are addressed back to each block that holds the word, packed.
3. Each block meets its answers and puts ids back by position. Decoding joins the ids of its words to pieces: the vocabulary,
   an id-to-piece table of a size fixed by its file, comes to the blocks by a broadcast join. ``decode`` is the same join
   for ids in any DataFrame, a row an id.

The splitting rule is the tokenizer's own: NFC, white space, lower case, then its pattern; special tokens in a text are
words of their own. Defined cases: null text is empty text with no ids; null and repeated ids are kept row by row.
"""

from __future__ import annotations

import functools
import itertools
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.llm.common import bucketed, table

# The word pattern and special tokens of the vocabulary file; its \s is this set of characters.
SPACE = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
SPECIAL = ("<|startoftext|>", "<|endoftext|>")
IS_SPECIAL = regex.compile("(" + "|".join(map(regex.escape, SPECIAL)) + ")")

BLOCK_CHARS = 12_000_000
PACK = 120_000
PLACE_BITS = 24  # an address is a block number and a place among its words


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def load_tokenizer(path: str):
    """The tokenizer without truncation and padding. It uses one thread, as a Spark task has one core: a pool of threads in
    every worker costs several times the work on small batches, and each thread keeps memory of its own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation(), tok.no_padding()
    return tok


def split_words(text: str | None) -> list[str]:
    """The pre-tokens of a text, before their bytes are mapped: what BPE is applied to, one by one."""
    if not text:
        return []
    if "<|" in text and len(parts := IS_SPECIAL.split(text)) > 1:
        return list(itertools.chain.from_iterable([p] if p in SPECIAL else split_words(p) for p in parts))
    if not text.isascii():
        # Lower case letter by letter: no final form of sigma.
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return WORD.findall(text.lower())


def _blocks(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, part, number = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId(), itertools.count()
        ids: list = []
        words: dict[str, int] = {}
        codes: list[np.ndarray] = []
        chars = 0

        def flush() -> pa.RecordBatch:
            nonlocal chars
            sizes = np.fromiter(map(len, codes), np.int64, len(codes))
            flat = np.concatenate(codes) if codes else np.empty(0, np.uint32)
            # Frequent words get small codes, and the four bytes of the codes lie apart: both make them compress well.
            by_count = np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")
            rank = np.empty(len(words), np.uint32)
            rank[by_count] = np.arange(len(words), dtype=np.uint32)
            spelled = list(words)
            planes = _planes(rank[flat] if len(words) else flat)
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([(part << 16) | next(number)], pa.int64()),
                    pa.array([list(ids)], pa.list_(pa.int64())),
                    pa.array([press.compress(sizes.tobytes())], pa.binary()),
                    pa.array([press.compress(planes)], pa.binary()),
                    pa.array([[spelled[i] for i in by_count]], pa.list_(pa.string())),
                ],
                ["_block", "_ids", "_sizes", "_codes", "_words"],
            )
            ids.clear(), words.clear(), codes.clear()
            chars = 0
            return out

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                split = split_words(text)
                ids.append(doc)
                codes.append(np.array([words.setdefault(w, len(words)) for w in split], np.uint32))
                chars += len(text or "") + 1
                if chars >= limit:
                    yield flush()
        if ids:
            yield flush()

    return run


BLOCK_SCHEMA = "_block long, _ids array<long>, _sizes binary, _codes binary, _words array<string>"


def word_blocks(docs: DataFrame, id_col: str, text_col: str, limit: int = BLOCK_CHARS) -> DataFrame:
    """The written table of blocks, bucketed by block."""
    base = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    blocks = base.mapInArrow(_blocks(limit), BLOCK_SCHEMA)
    return bucketed(blocks, "_block")


def _encode_runs(path: str):
    """Sorted (_word, _address) rows, each run of equal words encoded once, to packed answers per block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, press = load_tokenizer(path), zstandard.ZstdCompressor(level=3)
        held: dict[int, tuple[list, list, list]] = {}
        last, last_ids, count = None, b"", 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal count
            blobs = []
            for places, sizes, ids in held.values():
                at, n = np.array(places, np.uint32), np.array(sizes, np.uint32)
                parts = [np.array([len(at), n.sum()], np.uint32).tobytes(), _planes(at), _planes(n), _planes(np.frombuffer(b"".join(ids), np.uint32))]
                blobs.append(press.compress(b"".join(parts)))
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(blobs, pa.binary())], ["_block", "_blob"])
            held.clear()
            count = 0

        for batch in batches:
            words, at = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            starts = [i for i, w in enumerate(words) if i == 0 or w != words[i - 1]]
            new = [words[i] for i in starts if words[i] != last]
            ids = iter([e.ids for e in tok.encode_batch(new, add_special_tokens=False)])
            for i, j in itertools.pairwise([*starts, len(words)]):
                if words[i] != last:
                    last, last_ids = words[i], np.array(next(ids), np.uint32).tobytes()
                for address in at[i:j]:
                    places, sizes, all_ids = held.setdefault(address >> PLACE_BITS, ([], [], []))
                    places.append(address & (1 << PLACE_BITS) - 1), sizes.append(len(last_ids) // 4), all_ids.append(last_ids)
            count += len(words)
            if count >= PACK:
                yield from flush()
        yield from flush()

    return run


def _planes(x: np.ndarray) -> bytes:
    """The four bytes of 32-bit numbers, each kind together: they compress better so."""
    return np.ascontiguousarray(x, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(raw: bytes, n: int, at: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n, at).reshape(4, n).T).view("<u4").ravel()


def _restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with their answers and the vocabulary to documents: ids by position, and the pieces joined to them."""
    unpack, piece = zstandard.ZstdDecompressor(), None
    for batch in batches:
        for row in range(batch.num_rows):
            if piece is None:  # the same table beside every block
                pairs = batch.column(5)[row].values
                piece = dict(zip(pairs.field("_id").to_pylist(), (p.encode() for p in pairs.field("_piece").to_pylist()), strict=True))
            docs, n_words = batch.column(0)[row].as_py(), batch.column(3)[row].as_py()
            sizes = np.frombuffer(unpack.decompress(batch.column(1)[row].as_py()), np.int64)
            planes = unpack.decompress(batch.column(2)[row].as_py())
            codes = _numbers(planes, len(planes) // 4, 0)
            lengths, starts, texts, pool, base = np.zeros(n_words, np.int64), np.zeros(n_words, np.int64), [None] * n_words, [], 0
            for blob in batch.column(4)[row].as_py() or ():
                raw = unpack.decompress(blob)
                n, m = np.frombuffer(raw, np.uint32, 2).tolist()
                places, counts, ids = _numbers(raw, n, 8), _numbers(raw, n, 8 + 4 * n).astype(np.int64), _numbers(raw, m, 8 + 8 * n)
                ends = np.cumsum(counts)
                lengths[places], starts[places] = counts, base + ends - counts
                pool.append(ids)
                base += m
                spelled = [piece[i] for i in ids.tolist()]
                for place, a, b in zip(places.tolist(), (ends - counts).tolist(), ends.tolist(), strict=True):
                    texts[place] = b" ".join(spelled[a:b])
            if None in texts:
                raise ValueError("a word of the block has no answer")
            flat = np.concatenate(pool) if pool else np.empty(0, np.uint32)
            ends = np.cumsum(sizes)
            out: list[list] = [[], [], [], []]
            held = 0
            for doc, a, b in zip(docs, (ends - sizes).tolist(), ends.tolist(), strict=True):
                own = codes[a:b]
                each = lengths[own]
                total = int(each.sum())
                index = np.repeat(starts[own] - (np.cumsum(each) - each), each) + np.arange(total)
                decoded = b" ".join([t for c in own.tolist() if (t := texts[c])])
                for column, value in zip(out, (doc, total, flat[index].astype("<u4").tobytes(), decoded), strict=True):
                    column.append(value)
                held += len(decoded)
                if held > 2_000_000:
                    yield _encoded(out)
                    out, held = [[], [], [], []], 0
            if out[0]:
                yield _encoded(out)


def _encoded(out: list[list]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
    arrays = [pa.array(x, k) for x, k in zip(out, kinds, strict=True)]
    arrays[3] = arrays[3].cast(pa.string())
    return pa.RecordBatch.from_arrays(arrays, ["_id", "_n_tokens", "_ids", "_decoded"])


@functools.lru_cache(1)
def _pieces(path: str) -> list[bytes]:
    pieces = load_tokenizer(path).get_vocab(with_added_tokens=True)
    return [p.encode() for p in sorted(pieces, key=pieces.__getitem__)]


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """``(_id int, _piece string)``: the id-to-piece table, whose size is fixed by its file."""
    return spark.createDataFrame([(i, p.decode()) for i, p in enumerate(_pieces(path))], "_id int, _piece string")


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """``(id, _decoded)`` for rows with an ``array<int>`` of ids and an id of their own: the join with the vocabulary as
    a DataFrame. Null and empty arrays give an empty text; an id outside the vocabulary gives no piece."""
    each = encoded.select(F.col(id_col).alias("_row"), F.posexplode_outer(ids_col).alias("_pos", "_id"))
    met = each.join(F.broadcast(vocabulary(encoded.sparkSession, path or vocabulary_path())), "_id", "left")
    parts = F.sort_array(F.collect_list(F.when(F.col("_piece").isNotNull(), F.struct("_pos", "_piece"))))
    out = met.groupBy("_row").agg(parts.alias("_parts"))
    return out.select(F.col("_row").alias(id_col), F.array_join(F.col("_parts._piece"), " ").alias("_decoded"))


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Per row of ``docs``: id, ``_n_tokens``, ``_ids`` (little-endian unsigned 32-bit integers), ``_decoded``."""
    spark, path = docs.sparkSession, path or vocabulary_path()
    blocks = word_blocks(docs, id_col, text_col, block_chars)
    address = F.shiftleft("_block", PLACE_BITS).bitwiseOR(F.col("_place").cast("long")).alias("_address")
    places = blocks.select(F.posexplode("_words").alias("_place", "_word"), "_block").select("_word", address)
    runs = places.repartition("_word").sortWithinPartitions("_word").mapInArrow(_encode_runs(path), "_block long, _blob binary")
    answers = runs.groupBy("_block").agg(F.collect_list("_blob").alias("_blobs"))
    joined = blocks.withColumn("_n_words", F.size("_words")).join(answers.hint("shuffle_merge"), "_block", "left")
    pieces = vocabulary(spark, path).agg(F.collect_list(F.struct("_id", "_piece")).alias("_pieces"))
    joined = joined.select("_ids", "_sizes", "_codes", "_n_words", "_blobs").crossJoin(F.broadcast(pieces))  # one row of fixed size
    out = joined.mapInArrow(_restore, "_id long, _n_tokens long, _ids binary, _decoded string")
    return out.withColumnRenamed("_id", id_col)


def ids_array(packed: bytes) -> list[int]:
    """The ids behind ``_ids``."""
    return np.frombuffer(packed, "<u4").tolist()


def digests(out: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return out.select(
        id_col,
        F.col("_n_tokens").alias("n_tokens"),
        F.sha2("_ids", 256).alias("ids_sha256"),
        F.sha2(F.col("_decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode_decode(table(spark, sf_dir, "documents")))
