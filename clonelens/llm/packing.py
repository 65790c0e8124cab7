"""Sequence packing: first-fit decreasing with a tournament tree of bin capacities.

``cut_documents`` turns every text into token pieces of at most ``seq_len`` ids (the document's ids, then the end
id); ``pack`` assigns the pieces to sequences. Pieces are dealt into randomised groups of about ``group_size``
pieces, and first-fit decreasing runs independently in each, so no task sees more than one bounded group.

Defined cases: texts of any length and kind are encoded whole; null and empty texts are one piece holding the end id alone; a null doc_id stays null; repeated
rows are packed as often as they occur (the group is drawn from a per-row slot, so copies of one id are spread);
equal lengths are placed in the order of doc_id, start; an empty table gives no rows; other columns of the
documents are ignored by ``cut_documents``, and ``pack`` carries the columns of its input through.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

END_ID = 1
SEQ_LEN = 2048
#: Fixed value: the public pre-tokenisation pattern of the byte-level vocabulary.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: White space runs from this length on overflow the stack of the fast engine's pattern matcher.
LONG_SPACE = re.compile(r"\s{50000}")

CUT_SCHEMA = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, slot bigint, ids binary"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def encoder(path: str):
    """text -> uint32 ids, equal to ``tokenizers.Tokenizer.from_file(path).encode(text, add_special_tokens=False)``.

    The vocabulary of the file is run by a faster byte-pair engine; texts that hold the string of a special
    token go to the tokenizers library itself, which maps it to its id, and so do texts on which that engine gives
    up (very long runs of white space).
    """
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = [t["content"] for t in spec.get("added_tokens", [])]
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable}
    byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    fast = tiktoken.Encoding("file", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})
    whole = Tokenizer.from_file(path)

    def encode(text: str) -> np.ndarray:
        if not (any(s in text for s in special) or (len(text) > 50_000 and LONG_SPACE.search(text))):
            try:
                return np.array(fast.encode_ordinary(text), dtype="<u4")
            except BaseException as e:  # a panic of the engine is no Exception; nothing else is held back
                if type(e).__name__ != "PanicException":
                    raise
        return np.array(whole.encode(text, add_special_tokens=False).ids, dtype="<u4")

    return encode


def cut_documents(docs: DataFrame, tokenizer_path: str | None = None, seq_len: int = SEQ_LEN) -> DataFrame:
    """``docs(doc_id, text)`` to pieces ``doc_id, start, length, doc_tokens, slot, ids`` (ids: little-endian uint32).

    Every document is cut at multiples of seq_len; a map-only pass. ``slot`` spreads rows over groups.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path or default_tokenizer())
        end = np.array([END_ID], dtype="<u4")
        seen = 0
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            rows: list[tuple] = []
            held = 0
            for i, doc_id in enumerate(ids):
                text = texts[i].as_py()
                tokens = np.concatenate([encode(text), end]) if text else end
                for start in range(0, len(tokens), seq_len):
                    piece = tokens[start : start + seq_len]
                    slot = xxhash.xxh64_intdigest(f"{doc_id}:{start}:{seen}") >> 1
                    rows.append((doc_id, start, len(piece), len(tokens), slot, piece.tobytes()))
                    seen += 1
                    held += len(piece)
                if held > 1_000_000:
                    yield _pieces(rows)
                    rows, held = [], 0
            if rows:
                yield _pieces(rows)

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text")).mapInArrow(run, CUT_SCHEMA)


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "start", "length", "doc_tokens", "slot", "ids"]
    kinds = [pa.int64()] * 5 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


class CapacityTree:
    """Tournament tree over bins: each inner node holds the larger free capacity of its two children."""

    def __init__(self, bins: int, capacity: int):
        self.size = 1 << max(0, bins - 1).bit_length()
        self.free = [capacity] * (2 * self.size)

    def take(self, need: int) -> int:
        """Index of the leftmost bin with room for need, whose capacity is reduced."""
        free, node = self.free, 1
        while node < self.size:
            node <<= 1
            if free[node] < need:
                node += 1
        free[node] -= need
        bin_index = node - self.size
        node >>= 1
        while node:
            left, right = free[2 * node], free[2 * node + 1]
            free[node] = left if left > right else right
            node >>= 1
        return bin_index


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bins and offsets for lengths (already in decreasing order); no bin exceeds capacity."""
    bins = np.zeros(len(lengths), dtype=np.int64)
    offsets = np.zeros(len(lengths), dtype=np.int64)
    full = int(np.searchsorted(-lengths, -capacity, side="right"))
    bins[:full] = np.arange(full)
    if full < len(lengths):
        tree = CapacityTree(len(lengths) - full, capacity)
        used = [0] * (len(lengths) - full)
        for i in range(full, len(lengths)):
            need = int(lengths[i])
            b = tree.take(need)
            bins[i], offsets[i] = full + b, used[b]
            used[b] += need
    return bins, offsets


def pack(pieces: DataFrame, seq_len: int = SEQ_LEN, group_size: int = 4096) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces(doc_id, start, length, slot, ...); one shuffle of the pieces.

    ``pieces`` should be a stored table (it is counted first). The number of groups is pieces / group_size.
    """
    groups = max(1, -(-pieces.count() // group_size))
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in pieces.schema)}, sequence_id bigint, offset bigint"

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        order = sorted_order(table)
        table = table.take(order)
        bins, offsets = first_fit_decreasing(table.column("length").to_numpy(), seq_len)
        sequence = bins + (key[0].as_py() << 32)
        return table.drop_columns(["pack_group"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offsets))

    dealt = pieces.withColumn("pack_group", F.pmod(F.col("slot"), F.lit(groups)))
    return dealt.groupBy("pack_group").applyInArrow(run, schema)


def sorted_order(table: pa.Table) -> pa.Array:
    import pyarrow.compute as pc

    return pc.sort_indices(table, sort_keys=[("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("slot", "ascending")])


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, seq_len: int = SEQ_LEN) -> DataFrame:
    """Cut, digest and pack all documents: one row per piece with the columns of the packing contract."""
    pieces = cut_documents(docs, tokenizer_path, seq_len).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "slot"
    )
    stored = materialise(pieces, "pieces")
    return pack(stored, seq_len).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
