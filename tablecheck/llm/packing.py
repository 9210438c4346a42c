"""Packing documents into training sequences: concatenate and cut.

All documents form one stream of token ids. Two passes of prefix sums over the
partitions' token totals give every document its place in the stream without
sorting or shuffling a token; fixed windows of `window` tokens then cut it. A
document that crosses a window's end leaves one piece on each side; the pieces
that begin or end inside a document are marked as boundary pieces.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .base import cut, query, table

VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
CACHE_ENTRIES = 600_000
RUN = re.compile(r" (\s|$)")


class Encoder:
    """Token ids of texts, as bytes of `dtype` numbers.

    Byte-level BPE never joins a word to what stands before the single space in
    front of it, so a text is cut before its spaces and the ids of each part are
    remembered; `ranks` hold the same vocabulary in the form of a faster encoder.
    Texts in which white space follows a space (there the tokens depend on the
    whole run) are encoded whole, and those that may spell a special token by the
    tokenizer itself.
    """

    def __init__(self, vocabulary: str, ranks: str | None, dtype: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary_path(vocabulary))
        self.dtype = np.dtype(dtype)
        self.first: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}
        self.plain = self._plain(ranks) if ranks else self._slow

    def _plain(self, ranks: str) -> Callable[[str], list[int]]:
        import public_tokenizers
        import tiktoken

        with open(vocabulary_path(ranks), "rb") as lines:
            pairs = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        made = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=pairs, special_tokens={})
        return made.encode_ordinary

    def _slow(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _bytes(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def __call__(self, text: str) -> bytes:
        if "<|" in text:
            return self._bytes(self._slow(text))
        if RUN.search(text):
            return self._bytes(self.plain(text))
        head, *rest = text.split(" ")
        known = self.spaced
        if (start := self.first.get(head)) is None:
            start = self.first[head] = self._bytes(self.plain(head))
        for part in {p for p in rest if p not in known}:
            known[part] = self._bytes(self.plain(" " + part))
        coded = start + b"".join([known[p] for p in rest])
        for kept in (known, self.first):
            if len(kept) > CACHE_ENTRIES:
                kept.clear()
        return coded


_ENCODERS: dict[tuple[str, str | None, str], Encoder] = {}


def encoder(vocabulary: str, ranks: str | None, dtype: str) -> Encoder:
    """One encoder per Python worker, so that what it remembers outlives a task."""
    key = (vocabulary, ranks, dtype)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenized(
    docs: DataFrame, vocabulary: str = VOCABULARY, ranks: str | None = RANKS, end_id: int = 0
) -> DataFrame:
    """One row per document: doc_id, part, before (ids of the part ahead of it), n
    and ids (little-endian unsigned 16-bit, or 32-bit for larger vocabularies),
    written to the shared folder. `part` numbers the tasks; a document ends with
    `end_id`; a null text is empty."""
    from tokenizers import Tokenizer

    size = Tokenizer.from_file(vocabulary_path(vocabulary)).get_vocab_size()
    dtype = "<u2" if size <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, ranks, dtype)
        end = np.array([end_id], dtype).tobytes()
        width, before = np.dtype(dtype).itemsize, 0
        for batch in batches:
            ids = batch.column(1)
            for start in range(0, batch.num_rows, 512):
                texts = batch.column(2).slice(start, 512).to_pylist()
                coded = [encode(t or "") + end for t in texts]
                n = np.array([len(c) // width for c in coded], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(start, 512),
                        batch.column(0).slice(start, 512),
                        pa.array(before + np.cumsum(n) - n),
                        pa.array(n),
                        pa.array(coded, pa.binary()),
                    ],
                    names=["doc_id", "part", "before", "n", "ids"],
                )
                before += int(n.sum())

    source = docs.select(F.spark_partition_id().alias("part"), F.col("doc_id").cast("long"), "text")
    return cut(source.mapInArrow(run, "doc_id long, part int, before long, n long, ids binary"))


def pack(
    docs: DataFrame,
    window: int = 1024,
    vocabulary: str = VOCABULARY,
    ranks: str | None = RANKS,
    end_id: int = 0,
    keep_ids: bool = False,
) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, boundary (the piece begins or ends inside its document),
    and with `keep_ids` the piece's ids (binary, unsigned 32-bit). `ranks`: the
    same vocabulary for the faster encoder, or None.

    Every sequence holds `window` ids, the last one what is left. Null text: one
    end id. Repeated rows are packed as often as they occur; documents without
    doc_id are packed with a null id; an empty table gives no piece.
    """
    tokens = tokenized(docs, vocabulary, ranks, end_id)
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    # One row per task of the first pass; the sum before it is the second pass.
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # Written, so that its size is known when the join is planned: tokens stay put.
    totals = cut(totals.select("part", F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("ahead")))
    fields = (
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
        "sequence_id long, offset long, boundary boolean"
    ) + (", ids binary" if keep_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, at, n, ids = (batch.column(i).to_pylist() for i in range(4))
            out: list[tuple] = []
            for d, begin, size, raw in zip(doc, at, n, ids):
                values = np.frombuffer(raw, f"<u{len(raw) // size}").astype("<u4")
                start = 0
                while start < size:
                    place = (begin + start) % window
                    length = min(window - place, size - start)
                    piece = values[start : start + length].tobytes()
                    row = (d, start, length, zlib.crc32(piece), size, (begin + start) // window, place)
                    row += (start > 0 or length < size,)
                    out.append(row + ((piece,) if keep_ids else ()))
                    start += length
                if len(out) >= 4096:
                    yield _batch(out, keep_ids)
                    out = []
            if out:
                yield _batch(out, keep_ids)

    placed = tokens.join(totals, "part").select("doc_id", (F.col("ahead") + F.col("before")).alias("at"), "n", "ids")
    return placed.mapInArrow(run, fields)


def _batch(rows: list[tuple], keep_ids: bool) -> pa.RecordBatch:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "boundary"]
    kinds = [pa.int64()] * 7 + [pa.bool_()]
    if keep_ids:
        names, kinds = [*names, "ids"], [*kinds, pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


@query("op1_packing")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"))
