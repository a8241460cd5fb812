"""BPE encoding and decoding with content-defined chunk reuse (operator 10)."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _BYTE, _power, mix, table
from .packing import tokenizer_path

TOKENIZER = "word_bpe_49k.json"
SCHEMA = "doc_id long, n_tokens long, ids string, decoded string"
#: A chunk has more words than this.
WORDS = 5


def cuts(raw: np.ndarray, window: int = 32, mean: int = 2048) -> np.ndarray:
    """Content-defined cut positions: where a hash of the last `window` bytes falls under a share of 1 / mean.

    The hash rolls: it comes from running sums, so a position's hash depends on its window alone, wherever it lies.
    """
    if len(raw) <= window:
        return np.zeros(0, np.int64)
    up, down = _power(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=sums[1:])
    h = (sums[window:] - sums[:-window]) * down[: len(raw) - window + 1]
    return np.flatnonzero(mix(h) < np.uint64((1 << 64) // mean)) + window


def chunks(data: bytes, least: int = 64) -> list[bytes]:
    """data cut at its content-defined positions, moved to the next start of a character; a piece of fewer than `least`
    bytes or WORDS words stays with the next one, as no join could be repaired within it."""
    raw = np.frombuffer(data, np.uint8)
    out, start = [], 0
    for cut in cuts(raw).tolist():
        while cut < len(data) and raw[cut] & 0xC0 == 0x80:
            cut += 1
        if cut - start >= least and len(data[start:cut].split(None, WORDS)) > WORDS:
            out.append(data[start:cut])
            start = cut
    if out and len(data[start:].split(None, WORDS)) <= WORDS:
        out[-1] += data[start:]
    elif start < len(data):
        out.append(data[start:])
    return out


def tail(chunk: bytes, k: int) -> bytes | None:
    """chunk from its last k + 1 words on, the last of which may go on in the next chunk; None where it has no more."""
    words = chunk.rsplit(None, k + 1)
    return None if len(words) < k + 2 else b" ".join(words[1:]) + (b" " if chunk[-1:].isspace() else b"")


def head(chunk: bytes, k: int) -> bytes | None:
    """chunk up to its first k + 1 words, the first of which may have begun in the chunk before."""
    words = chunk.split(None, k + 1)
    return None if len(words) < k + 2 else (b" " if chunk[:1].isspace() else b"") + b" ".join(words[:-1])


class Encoder:
    """Encodes with memory: each distinct chunk once and each distinct join of two chunks once, until the store is full
    and emptied. encoded, joined, widened and whole count chunks encoded, joins repaired, windows that had to grow, and
    texts encoded as a whole because no window agreed."""

    def __init__(self, path: str | None = None, max_bytes: int = 16 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or tokenizer_path(TOKENIZER))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.number, self.token = pa.array([str(i) for i in range(size)]), pa.array([self.tokenizer.id_to_token(i) or "" for i in range(size)])
        self.chunks: dict[bytes, np.ndarray] = {}
        self.joins: dict[tuple[bytes, bytes], tuple[int, np.ndarray, int] | None] = {}
        self.max_bytes, self.held = max_bytes, 0
        self.encoded = self.joined = self.widened = self.whole = 0

    def ids(self, pieces: list[bytes]) -> list[np.ndarray]:
        some = [p.decode("utf-8", "surrogatepass") for p in pieces]
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]

    def _repair(self, pairs: list[tuple[bytes, bytes]]) -> None:
        """For each pair of neighbours: how many of the left one's last ids and of the right one's first ids the ids of a
        window across the cut replace.

        The window holds k whole words on either side besides the cut one. It counts when the left chunk's ids end with
        those of the window's left part, the right chunk's begin with those of its right part, and the window's own ids
        begin and end as these do; else it is encoded again with twice as many words.
        """
        k = 1
        while pairs:
            left, right = [tail(a, k) for a, _ in pairs], [head(b, k) for _, b in pairs]
            for pair, x, y in zip(pairs, left, right):
                if x is None or y is None:
                    self.joins[pair] = None
            kept = [(p, x, y) for p, x, y in zip(pairs, left, right) if x is not None and y is not None]
            found = self.ids([z for _, x, y in kept for z in (x, y, x + y)])
            pairs = []
            for i, (pair, _, _) in enumerate(kept):
                x, y, w = found[3 * i : 3 * i + 3]
                a, b = self.chunks[pair[0]], self.chunks[pair[1]]
                agree = len(x) and len(y) and len(w) and np.array_equal(a[-len(x) :], x) and np.array_equal(b[: len(y)], y) and w[0] == x[0] and w[-1] == y[-1]
                if agree:
                    self.joins[pair] = len(x), w, len(y)
                else:
                    pairs.append(pair)
            self.joined += len(kept) - len(pairs)
            self.widened += len(pairs)
            k *= 2

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        docs = [chunks(t.encode("utf-8", "surrogatepass")) for t in texts]
        fresh = [c for c in dict.fromkeys(c for d in docs for c in d) if c not in self.chunks]
        self.chunks.update(zip(fresh, self.ids(fresh)))
        self.encoded += len(fresh)
        self.held += sum(map(len, fresh))
        self._repair([p for p in dict.fromkeys(p for d in docs for p in zip(d, d[1:])) if p not in self.joins])
        out = []
        for text, doc in zip(texts, docs):
            pieces, skip = [], 0
            for i, chunk in enumerate(doc):
                ids = self.chunks[chunk]
                if i + 1 < len(doc):
                    join = self.joins[chunk, doc[i + 1]]
                    if join is None or skip + join[0] > len(ids):
                        self.whole += 1
                        pieces = self.ids([text.encode("utf-8", "surrogatepass")])
                        break
                    pieces += [ids[skip : len(ids) - join[0]], join[1]]
                    skip = join[2]
                else:
                    pieces.append(ids[skip:])
            out.append(np.concatenate(pieces) if pieces else np.zeros(0, np.uint32))
        if self.held > self.max_bytes:
            self.chunks.clear()
            self.joins.clear()
            self.held = 0
        return out


def joined(names: pa.Array, ids: list[np.ndarray]) -> pa.Array:
    """Each text's ids by name, joined by one space."""
    cut = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(cut), names.take(pa.array(np.concatenate(ids)))), " ")


def encode(docs: DataFrame, tokenizer: str | None = None, batch_chars: int = 1 << 20) -> DataFrame:
    """Encodes and decodes docs (doc_id, text): SCHEMA, with the ids in decimal joined by one space.

    Each task encodes every distinct chunk of its documents once and repairs each distinct join of two chunks; its store
    is bounded, and a chunk that meets an emptied store is encoded again, with the same result. There is no shuffle. Null
    and empty texts have no ids and decode to the empty text; repeated rows come out as often as they occur; a null
    doc_id stays null; an empty table gives no rows; other columns are ignored. tokenizer: a file that all executors have.
    """
    def run(batches):
        encoder = Encoder(tokenizer)
        for batch in batches:
            ids, texts, size = [], [], 0
            for i, (doc, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1))):
                ids.append(doc)
                texts.append(text.as_py() or "")
                size += len(texts[-1])
                if size >= batch_chars or i + 1 == batch.num_rows:
                    every = encoder.encode(texts)
                    yield pa.record_batch({"doc_id": pa.array(ids, pa.int64()), "n_tokens": pa.array([*map(len, every)], pa.int64()), "ids": joined(encoder.number, every), "decoded": joined(encoder.token, every)})
                    ids, texts, size = [], [], 0

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def op10_bpe_chunk_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents")).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
