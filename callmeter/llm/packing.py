"""Harmonic packing of token sequences (operator 9)."""

from __future__ import annotations

import json
from collections import deque
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

TOKENIZER = "byte_bpe_50k.json"
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(4)
def byte_encoder(path: str):
    """The byte-level BPE of a tokenizers file as a tiktoken encoding: same vocabulary, same ids, a fraction of the time.

    An id serves as a rank, so merges have to be in order of the ids they make, which is checked. Special tokens in a text
    are encoded as such, as the tokenizers library does by default.
    """
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    merged = [spec["model"]["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
    if merged != sorted(merged):
        raise ValueError("this tokenizer's merges aren't in the order of their ids")
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*plain}))}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


class Packer:
    """Packs the documents of one worker. Rows: (doc_id, start, ids, doc_tokens, sequence number, offset).

    Harmonic classes: a document of a length in (capacity / (j + 1), capacity / j] belongs to class j, whose bins take
    exactly j of them, whole. Each class has one open bin. What such a bin leaves empty is filled from `stock`, the
    documents longer than the capacity, which have to be cut anyway: whole sequences are cut off them while the stock
    holds `most` tokens or more, and pieces of the size that a bin lacks from what is left. A full bin that finds no
    stock waits; when `waiting` bins do, the next document is cut for them, of whatever class it is. At the end, what is
    in open or waiting bins or in stock is laid end to end into whole sequences, and the last is cut at powers of two.
    """

    def __init__(self, capacity: int, waiting: int = 32, most: int | None = None):
        self.capacity, self.wait, self.most = capacity, waiting, 4 * capacity if most is None else most
        self.next, self.open, self.full, self.rows = 0, {}, deque(), []
        self.stock, self.stocked = deque(), 0

    def _close(self, pieces: list) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, ids, total, self.next, offset))
            offset += len(ids)
        self.next += 1

    def _take(self, size: int) -> list:
        """Pieces of the stock with `size` tokens in all."""
        out = []
        self.stocked -= size
        while size:
            doc, start, ids, total = self.stock.popleft()
            out.append((doc, start, ids[:size], total))
            if len(ids) > size:
                self.stock.appendleft((doc, start + size, ids[size:], total))
            size -= len(out[-1][2])
        return out

    def _fill(self) -> None:
        """Closes full bins from the stock, the first that it suffices for, as long as there is one."""
        while self.full and self.full[0][1] <= self.stocked:
            pieces, lack = self.full.popleft()
            self._close(pieces + self._take(lack))

    def add(self, doc, ids: np.ndarray) -> None:
        piece = (doc, 0, ids, len(ids))
        if len(ids) > self.capacity or len(self.full) >= self.wait:
            self.stock.append(piece)
            self.stocked += len(ids)
            self._fill()
            while self.stocked >= self.most:
                self._close(self._take(self.capacity))
            return
        j = self.capacity // len(ids)
        pieces = self.open.setdefault(j, [])
        pieces.append(piece)
        if len(pieces) == j:
            del self.open[j]
            self.full.append((pieces, self.capacity - sum(len(p[2]) for p in pieces)))
            self._fill()

    def finish(self) -> None:
        """Lays what is left end to end. Bins go first, so that their documents are cut only at a sequence's end."""
        rest = [p for j in sorted(self.open) for p in self.open[j]] + [p for pieces, _ in self.full for p in pieces]
        self.open, self.full = {}, deque()
        self.stock.extendleft(reversed(rest))
        self.stocked = left = sum(len(p[2]) for p in self.stock)
        while left:
            room = min(self.capacity, 1 << (left.bit_length() - 1))
            self._close(self._take(room))
            left -= room

    def batch(self, base: int) -> pa.RecordBatch:
        doc, start, ids, total, seq, offset = zip(*self.rows)
        self.rows = []
        return pa.record_batch({
            "doc_id": pa.array(doc, pa.int64()), "start": pa.array(start, pa.int64()), "length": pa.array([len(x) for x in ids], pa.int64()),
            "ids": pa.array([x.tobytes() for x in ids], pa.binary()), "doc_tokens": pa.array(total, pa.int64()),
            "sequence_id": pa.array([base + x for x in seq], pa.int64()), "offset": pa.array(offset, pa.int64()),
        })


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """Packs docs (doc_id, text) into sequences of at most `capacity` tokens; one row per piece (SCHEMA, ids as
    little-endian unsigned 32-bit words).

    Every input partition is packed by its own task, so there is no shuffle, memory holds one batch, at most one open
    bin per class, some full bins and a stock of long documents, and a repeated task gives the same sequences. A sequence
    id is the partition's number and a counter. tokenizer: a file that all executors have. Null and empty texts are the end id alone; repeated rows are packed as often as they occur; a null doc_id stays null;
    an empty table gives no rows; other columns are ignored.
    """
    def run(batches):
        encoder = byte_encoder(tokenizer or tokenizer_path(TOKENIZER))
        special = set(encoder.special_tokens_set)
        packer, base = Packer(capacity), TaskContext.get().partitionId() << 36
        for batch in batches:
            held = 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encoder.encode_to_numpy(text.as_py() or "", allowed_special=special, disallowed_special=())
                packer.add(doc, np.append(ids, end_id).astype("<u4"))
                held += len(ids)
                if held > 1 << 20 and packer.rows:
                    yield packer.batch(base)
                    held = 0
            if packer.rows:
                yield packer.batch(base)
        packer.finish()
        if packer.rows:
            yield packer.batch(base)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def op9_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(table(spark, sf_dir, "documents")))


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
