"""Fill-in-the-middle transformation of texts by a sparse exception index (operator 11)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _SPACE, table

PREFIX, SUFFIX, MIDDLE = MARKS = "<P>", "<S>", "<M>"
#: Bytes of text that are indexed at once; longer texts are indexed alone.
BLOCK = 4 << 20
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, prefix_bytes long, middle_bytes long, output string"

# Bytes that the UTF-8 form of a character has beyond one, by its first byte.
_EXCESS = np.zeros(256, np.int64)
_EXCESS[0xC0:0xE0], _EXCESS[0xE0:0xF0], _EXCESS[0xF0:0xF8] = 1, 2, 3


class Exceptions:
    """The characters of UTF-8 bytes that have more than one byte: their byte and character positions, and the excess
    bytes up to them. All between them is one byte per character, so positions there differ by that sum alone."""

    def __init__(self, raw: np.ndarray):
        self.byte = np.flatnonzero(raw >= 0xC0)
        self.excess = np.concatenate([[0], np.cumsum(_EXCESS[raw[self.byte]])])
        self.char = self.byte - self.excess[:-1]

    def to_bytes(self, chars) -> np.ndarray:
        """Byte positions of character positions."""
        return chars + self.excess[np.searchsorted(self.char, chars)]

    def to_chars(self, at) -> np.ndarray:
        """Character positions of byte positions, which are those of whole characters."""
        return at - self.excess[np.searchsorted(self.byte, at)]


def unit_ends(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where the units `[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+` of texts end that lie one after the other
    in raw, up to `ends`: after every run of other characters, and after white space that ends a text."""
    space = _SPACE[raw]
    last = np.zeros(len(raw) + 1, bool)
    last[ends] = True
    return np.flatnonzero(last[1:] | (~space & np.append(space[1:], True))) + 1


def blocks(column: pa.Array, size: int):
    """(first row, bytes, offsets) of a string column, in blocks of `size` bytes or of one row."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        yield i, raw[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def _cut(batches, block: int):
    """Batches of (id, text, form, two numbers) → SCHEMA: texts cut after two numbers of units modulo one more than they have."""
    for batch in batches:
        numbers = [batch.column(i).to_numpy() for i in (3, 4)]
        for first, raw, at in blocks(batch.column(1), block):
            rows = slice(first, first + len(at) - 1)
            index, units = Exceptions(raw), unit_ends(raw, at[1:])
            before = np.searchsorted(units, at, "right")
            n = np.diff(before)
            picked = np.sort(np.stack([x[rows] % (n + 1) for x in numbers]), axis=0)
            # the end of unit k of a text, or its start for none
            low, high = (np.where(k > 0, np.append(units, 0)[before[:-1] + k - 1], at[:-1]) for k in picked)
            chars = [index.to_chars(x) for x in (at[:-1], low, high)]
            forms = batch.column(2).slice(first, len(n)).to_pylist()
            plain = np.array([f == "plain" for f in forms], bool)
            size = lambda x: pa.array(x, pa.int64(), mask=plain)
            yield pa.record_batch({
                "doc_id": batch.column(0).slice(first, len(n)), "n": pa.array(n, pa.int64()), "form": pa.array(forms, pa.string()), "prefix_chars": size(chars[1] - chars[0]), "middle_chars": size(chars[2] - chars[1]),
                "prefix_bytes": size(low - at[:-1]), "middle_bytes": size(high - low),
                "output": pa.array([laid_out(f, raw[a:p].tobytes(), raw[p:m].tobytes(), raw[m:b].tobytes()) for f, a, p, m, b in zip(forms, at, low, high, at[1:])], pa.binary()).view(pa.string()),
            })


def laid_out(form: str, prefix: bytes, middle: bytes, suffix: bytes) -> bytes:
    """The three parts of a text in the order of a form, each after its mark; plain has none."""
    p, s, m = (x.encode() for x in MARKS)
    if form == "plain":
        return prefix + middle + suffix
    return p + prefix + s + suffix + m + middle if form == "psm" else s + suffix + p + prefix + m + middle


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80, block: int = BLOCK) -> DataFrame:
    """docs (doc_id, text) with their parts laid out for filling in the middle; SCHEMA, one row per row.

    A text is cut into units of white space and what follows it. The sha256 of `seed:doc_id` gives two cuts between units
    and the form: `rate` percent of the texts are moved, `spm` percent of these as suffix, prefix, middle, the others as
    prefix, suffix, middle; empty texts, and those that contain a mark, stay plain. n counts units; prefix and middle are
    measured in characters and in bytes, null where plain. Texts are cut as bytes: an index of the multibyte characters
    turns the cuts into characters, so that no text is decoded.

    A null text is an empty one; a null doc_id is hashed as no digits and stays null; rows with the same id and text get
    the same result each; an empty table gives no rows; other columns are ignored. No shuffle; a task holds a batch.
    """
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draw = [F.conv(F.substring("digest", 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]
    text = F.col("text")
    stays = (text == "") | F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE)) | (draw[2] % 100 >= rate)
    form = F.when(stays, "plain").when(draw[3] % 100 < spm, "spm").otherwise("psm")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), h.alias("digest"))
    return rows.select("doc_id", "text", form.alias("form"), draw[0].alias("h1"), draw[1].alias("h2")).mapInArrow(lambda batches: _cut(batches, block), SCHEMA)


def restored(output: str = "output", form: str = "form") -> Column:
    """The text of an output: its parts, told apart by their marks, put back in order. A mark can't arise where parts
    meet, since each starts with its only `<`."""
    rest = F.substr(output, F.lit(len(PREFIX) + 1))

    def split(c: Column, mark: str) -> tuple[Column, Column]:
        both = F.split(c, mark, 2)
        return F.get(both, F.lit(0)), F.get(both, F.lit(1))

    prefix, more = split(rest, SUFFIX)
    suffix, middle = split(more, MIDDLE)
    psm = F.concat(prefix, middle, suffix)
    suffix, more = split(rest, PREFIX)
    prefix, middle = split(more, MIDDLE)
    return F.when(F.col(form) == "plain", F.col(output)).when(F.col(form) == "psm", psm).otherwise(F.concat(prefix, middle, suffix))


def parts(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """docs (doc_id, text, prefix_chars, middle_chars) → doc_id, prefix, middle, suffix: whole texts cut anew at stored
    numbers of characters. Null texts are empty; null numbers count as 0, too large ones as all that is left."""
    def run(batches):
        for batch in batches:
            sizes = [np.maximum(batch.column(i).to_numpy(zero_copy_only=False), 0) for i in (2, 3)]
            for first, raw, at in blocks(batch.column(1), block):
                rows = slice(first, first + len(at) - 1)
                index = Exceptions(raw)
                start, end = index.to_chars(at[:-1]), index.to_chars(at[1:])
                low = np.minimum(start + np.minimum(sizes[0][rows], end - start), end)
                high = low + np.minimum(sizes[1][rows], end - low)
                cuts = [at[:-1], index.to_bytes(low), index.to_bytes(high), at[1:]]
                yield pa.record_batch({"doc_id": batch.column(0).slice(first, len(at) - 1)} | {
                    name: pa.array([raw[a:b].tobytes() for a, b in zip(cuts[i], cuts[i + 1])], pa.binary()).view(pa.string()) for i, name in enumerate(("prefix", "middle", "suffix"))
                })

    size = [F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c) for c in ("prefix_chars", "middle_chars")]
    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *size).mapInArrow(run, "doc_id long, prefix string, middle string, suffix string")


def op11_exception_index_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_in_middle(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))
