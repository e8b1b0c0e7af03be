"""Vectorised text primitives over Arrow buffers.

Texts stay UTF-8 bytes from the scan to the result: an Arrow string column is
viewed as one byte array plus offsets, and words, lines and hashes come from a
few numpy passes over it, without a Python object per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import cut_lineage as session_checkpoint  # noqa: F401

#: Texts are handled in chunks of about so many bytes; a longer text is a chunk of its own.
CHUNK_BYTES = 2 << 20
#: Within a chunk, byte-level arrays cover at most about so many bytes at once.
BLOCK_BYTES = 2 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[65:91] = IS_WORD[97:123] = True
IS_WORD[128:] = True
IS_TOKEN = np.ones(256, bool)
IS_TOKEN[:33] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n of each at least."""
    if len(_powers.get("p", ())) < n:
        size = max(n, BLOCK_BYTES + 4096)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for name, b in (("p", _BASE), ("i", inverse)):
            a = np.full(size, b, np.uint64)
            a[0] = 1
            _powers[name] = np.multiply.accumulate(a)
    return _powers["p"], _powers["i"]


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and its n + 1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("") if column.null_count else column.cast(pa.large_string())
    n = len(column)
    _, off, data = column.buffers()
    if n == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


#: Scripts that put no spaces between words, as ranges of code points: each of these characters is a word of its own.
SPACELESS = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0xA4CF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))


def fold(raw: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and for two-byte Latin-1 letters; byte lengths never change."""
    low = _LOWER[raw]
    at = np.flatnonzero(raw[:-1] == 0xC3) + 1 if len(raw) else np.zeros(0, np.int64)
    second = raw[at]
    low[at[(second >= 0x80) & (second <= 0x9E) & (second != 0x97)]] += 0x20
    return low


def folded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """as_bytes() in lower case, in any script. Bytes may move, but each code point stays one code point."""
    raw, offsets = as_bytes(column)
    if not len(raw) or raw.max() < 0xC4:
        return fold(raw), offsets
    return as_bytes(pc.utf8_lower(column))


def spaceless(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions and sizes of the characters of SPACELESS."""
    at = np.flatnonzero(raw >= 0xE0)
    if not len(at):
        return at, at
    four = raw[at] >= 0xF0
    wide = np.append(raw, np.zeros(3, np.uint8)).astype(np.uint32) & 0x3F
    code = np.where(four, ((wide[at] & 7) << 18) | (wide[at + 1] << 12) | (wide[at + 2] << 6) | wide[at + 3], ((wide[at] & 15) << 12) | (wide[at + 1] << 6) | wide[at + 2])
    some = np.zeros(len(at), bool)
    for a, b in SPACELESS:
        some |= (code >= a) & (code <= b)
    return at[some], np.where(four[some], 4, 3)


def spaceless_class() -> str:
    """SPACELESS as the inside of a character class of RE2."""
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in SPACELESS)


def _blocks(raw: np.ndarray, inside: np.ndarray, breaks: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about BLOCK_BYTES that cut no word."""
    n, at = len(raw), 0
    while at < n:
        end = min(n, at + BLOCK_BYTES)
        if end < n:
            start = breaks[np.searchsorted(breaks, end, "right") - 1]
            while end < n and inside[raw[end]] and inside[raw[end - 1]] and end != start:
                window = np.flatnonzero(~inside[raw[end : end + 4096]])
                later = breaks[np.searchsorted(breaks, end) : np.searchsorted(breaks, end) + 1]
                stop = end + (int(window[0]) if len(window) else 4096)
                end = min(n, stop, int(later[0]) if len(later) else n)
                start = breaks[np.searchsorted(breaks, end, "right") - 1]
        yield at, end
        at = end


class Words:
    """Words of consecutive texts: runs of bytes of ``inside``, cut at each character of SPACELESS.

    start, end: byte positions; hash: 64 bits, equal for equal folded bytes;
    first: n + 1 positions in these arrays, at which each text's words begin.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray = IS_WORD, folded: np.ndarray | None = None, hashed: bool = True):
        low = fold(raw) if folded is None else folded
        at, size = spaceless(raw)
        alone = np.union1d(at, at + size)
        parts: list[tuple[np.ndarray, ...]] = []
        for a, b in _blocks(raw, inside, offsets):
            is_in = np.zeros(b - a + 2, bool)
            is_in[1:-1] = inside[raw[a:b]]
            edge = np.zeros(b - a + 1, bool)
            cut = offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b, "right")] - a
            edge[cut] = True
            edge[alone[np.searchsorted(alone, a) : np.searchsorted(alone, b, "right")] - a] = True
            start = np.flatnonzero(is_in[1:-1] & (~is_in[:-2] | edge[:-1]))
            end = np.flatnonzero(is_in[1:-1] & (~is_in[2:] | edge[1:])) + 1
            if hashed:
                p, inv = _power(b - a)
                total = np.zeros(b - a + 1, np.uint64)
                np.cumsum((low[a:b] + np.uint64(1)) * p[: b - a], out=total[1:])
                parts.append((start + a, end + a, mix((total[end] - total[start]) * inv[start])))
            else:
                parts.append((start + a, end + a, np.zeros(0, np.uint64)))
        join = lambda k, t: np.concatenate([x[k] for x in parts]) if parts else np.zeros(0, t)
        self.start, self.end, self.hash = join(0, np.int64), join(1, np.int64), join(2, np.uint64)
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """For each word, the number of its text."""
        return np.repeat(np.arange(len(self.count)), self.count)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive entries, for each place that has n."""
    out = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for j in range(n):
        out = out * _BASE + hashes[j : j + len(out)]
    return mix(out)


def char_positions(raw: np.ndarray) -> np.ndarray:
    """n + 1 numbers: code points before each byte."""
    out = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=out[1:])
    return out


def chunks(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have about CHUNK_BYTES together."""
    n = batch.num_rows
    if n == 0:
        return
    _, offsets = as_bytes(batch.column(text))
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1
        end = min(n, max(end, at + 1))
        yield batch.slice(at, end - at)
        at = end


def ids_and_texts(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """The columns an operator reads, the id as bigint; rows without an id are left out."""
    return docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text"), *(docs[c].cast("string").alias(a) for c, a in zip(more[::2], more[1::2], strict=True))).where(F.col("doc_id").isNotNull())


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


class Sums:
    """Running sums over the hashes of words, from which the digest of any run of words follows at once."""

    _BASES = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))
    _held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, hashes: np.ndarray):
        n = len(hashes) + 1
        self.sums = []
        for k, base in enumerate(self._BASES):
            if k not in self._held or len(self._held[k][0]) < n:
                both = []
                for b in (base, np.uint64(pow(int(base), -1, 1 << 64))):
                    a = np.full(max(n, 1 << 20), b, np.uint64)
                    a[0] = 1
                    both.append(np.multiply.accumulate(a))
                self._held[k] = (both[0], both[1])
            total = np.zeros(n, np.uint64)
            np.cumsum((mix(hashes + np.uint64(k)) if k else hashes) * self._held[k][0][: n - 1], out=total[1:])
            self.sums.append(total)

    def digest(self, k: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """64 bits, number k of 2, of the words from a up to b."""
        return mix((self.sums[k][b] - self.sums[k][a]) * self._held[k][1][a] + (b - a).astype(np.uint64))
