"""Words of texts as numbers: the shared fast path of the text operators.

A word is a run of bytes other than \\x20 and \\x09-\\x0D, which is what `bytes.split()` yields on UTF-8.
Each Python worker keeps one WordTable, of the use it was last put to: words' hashes with row numbers and columns of
per-word values (hashes, token ids, counts), so that a word costs its computation once and a lookup after that.
A table that passes its limit forgets the words it has seen least; that changes speed, never results.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Words that a table holds, and bytes it may take, before it forgets; and bytes of text handled at a time.
TABLE_WORDS, TABLE_BYTES, CHUNK_BYTES = 400_000, 128 << 20, 1 << 19
#: Bytes that a word takes in a table at most, beside what its owner keeps for each of its bytes: its slots, hash, size, uses and columns.
WORD_BYTES = 180


class WordTable:
    """Row numbers by word. `fill(words)` returns, for new words, a tuple of arrays with one value for each word.

    Words are told apart by their 64-bit hashes, which lie in an open-addressed table, so that a batch of words is looked up
    at once and none but new words becomes an object.
    """

    def __init__(self, fill: Callable[[list[bytes]], tuple[np.ndarray, ...]], limit: int = TABLE_WORDS):
        self.fill, self.limit = fill, limit
        self.count = self.bytes = 0
        self.own = (np.zeros(0, np.uint64), np.zeros(0, np.int64))  # each row's hash and size
        self.room: list[np.ndarray] = []  # these and the columns, and space to grow
        self.columns: tuple[np.ndarray, ...] | None = None
        self.uses = np.zeros(0, np.int64)
        self.forgot = 0  # how many times
        self._place(np.zeros(0, np.uint64), 1 << 12)

    def __len__(self) -> int:
        return self.count

    def __contains__(self, word: bytes) -> bool:
        return bool(self._find(exact_hashes(word + PAD, np.zeros(1, np.int64), np.array([len(word)])))[0] >= 0)

    def full(self) -> bool:
        """Whether the next call of rows() makes the table forget, which changes row numbers."""
        return len(self) > self.limit or self.bytes > TABLE_BYTES

    def _place(self, hashes: np.ndarray, slots: int) -> None:
        """Starts the slots anew with these hashes, row by row."""
        self.slots, self.slot_rows = np.zeros(slots, np.uint64), np.zeros(slots, np.int32)
        self._put(hashes, 0)

    def _put(self, hashes: np.ndarray, first: int) -> None:
        """Gives new, distinct hashes their slots, and rows from `first` on."""
        mask = np.uint64(len(self.slots) - 1)
        at, rows = (hashes & mask).astype(np.int64), np.arange(first, first + len(hashes), dtype=np.int32)
        while len(at):
            free = np.flatnonzero(self.slots[at] == 0)
            self.slots[at[free]] = hashes[free]
            mine = self.slots[at] == hashes  # of several at one slot, the last
            self.slot_rows[at[mine]] = rows[mine]
            rest = ~mine
            hashes, rows, at = hashes[rest], rows[rest], (at[rest] + 1) & int(mask)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Their rows, -1 for those that have none."""
        mask = len(self.slots) - 1
        at = (hashes & np.uint64(mask)).astype(np.int64)
        got = self.slots[at]
        out = np.where(got == hashes, self.slot_rows[at], np.int32(-1))
        rest = np.flatnonzero((got != hashes) & (got != 0))
        at = at[rest]
        while len(rest):
            at = (at + 1) & mask
            got, own = self.slots[at], hashes[rest]
            hit = got == own
            out[rest[hit]] = self.slot_rows[at[hit]]
            on = ~hit & (got != 0)
            rest, at = rest[on], at[on]
        return out

    def forget(self) -> np.ndarray:
        """Keeps the words used most, half of what fits; returns their former rows. Words used once always go."""
        self.forgot += 1
        most = self.limit // 2
        order = np.argsort(-self.uses, kind="stable")[:most]
        keep = np.sort(order[self.uses[order] > 1])
        total = np.cumsum(self.own[1][keep] + WORD_BYTES)
        fit = int(np.searchsorted(total, TABLE_BYTES // 2, "right"))
        keep = keep[:fit]
        self.bytes = int(total[fit - 1]) if fit else 0
        self.count = len(keep)
        self.own, self.columns = tuple(x[keep] for x in self.own), tuple(c[keep] for c in self.columns)
        self.room = []
        self.uses = self.uses[keep] // 2
        self._place(self.own[0], len(self.slots))
        return keep

    def rows(self, text: bytes, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Row numbers of the text's words, of `size` bytes from `begin` on; PAD ends the text. Columns hold until the next call."""
        if self.full():
            self.forget()
        hashes = exact_hashes(text, begin, size)
        out = self._find(hashes)
        missing = np.flatnonzero(out < 0)
        if len(missing) or self.columns is None:
            values, first, where = np.unique(hashes[missing], return_index=True, return_inverse=True)
            order = np.argsort(first, kind="stable")  # as they come in the text
            row = np.empty(len(order), np.int32)
            row[order] = np.arange(self.count, self.count + len(order), dtype=np.int32)
            out[missing] = row[where]
            at = missing[first[order]]
            a, n = begin[at].tolist(), size[at]
            got = (values[order], n.astype(np.int64), *self.fill([text[x : x + k] for x, k in zip(a, n.tolist())]))
            old, self.count = self.count, self.count + len(order)
            self.bytes += int(n.sum()) + WORD_BYTES * len(order)
            if not self.room or self.count > len(self.room[0]):
                grown = max(self.count + self.count // 2, 1024)
                had = (*self.own, *(self.columns or (x[:0] for x in got[2:])))
                self.room = [np.concatenate((c, np.zeros(grown - old, x.dtype))) for c, x in zip(had, got, strict=True)]
            for have, x in zip(self.room, got, strict=True):
                have[old : self.count] = x
            self.own, self.columns = (tuple(c[: self.count] for c in x) for x in (self.room[:2], self.room[2:]))
            if 2 * self.count > len(self.slots):
                self._place(self.own[0], 1 << (4 * self.count - 1).bit_length())
            else:
                self._put(values[order], old)
        seen = np.bincount(out, minlength=len(self))
        seen[: len(self.uses)] += self.uses
        self.uses = seen
        return out


class Derived:
    """Columns that are worked out from a table's column of hashes, or from those it finds words by, kept up with the table as it grows and forgets."""

    def __init__(self, table: WordTable, column: int | None, work_out: Callable[[np.ndarray], tuple[np.ndarray, ...]]):
        self.table, self.column, self.work_out = table, column, work_out
        self.forgot, self.columns = -1, ()

    def now(self) -> tuple[np.ndarray, ...]:
        """The columns, as long as the table's own."""
        h = self.table.own[0] if self.column is None else self.table.columns[self.column]
        if self.forgot != self.table.forgot or not self.columns:
            self.forgot, self.columns = self.table.forgot, self.work_out(h)
        elif (done := len(self.columns[0])) < len(h):
            self.columns = tuple(np.concatenate((c, x)) for c, x in zip(self.columns, self.work_out(h[done:]), strict=True))
        return self.columns


_held: dict[object, object] = {}


def held(use: object, make: Callable[[], object]):
    """This worker's table for a use. A worker serves many operators one after the other; it drops the table of the last use first, so that it holds one."""
    if use not in _held:
        _held.clear()
        _give_back()
        _held[use] = make()
        _give_back()  # what it took to make it
    return _held[use]


def hash64(words: list[bytes]) -> tuple[np.ndarray]:
    """The stable 64-bit hash of each word."""
    return (np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64),)


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with about `limit` bytes in the text column (one row at least), and its texts as UTF-8; null is empty."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
        sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
        part = (np.cumsum(sizes) - sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a), [x or b"" for x in col.slice(a, b - a).to_pylist()]
        del col
    _give_back()


def _give_back() -> None:
    """Returns freed memory to the system: a worker lives on after its task, beside those of later stages."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL(None).malloc_trim(0)


#: Follows a text whose words exact_hashes() reads by eights.
PAD = bytes(8)
#: A word of more bytes is hashed by itself.
LONG_WORD = 64
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def exact_hashes(text: bytes, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes, never 0, of the text's words as they are, of `size` bytes from `begin` on; PAD ends the text."""
    eights = np.ndarray(len(text) - 7, "<u8", text, 0, (1,))
    out = size.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    rest = slice(None)
    for k in range(0, LONG_WORD, 8):
        if k:
            rest = np.flatnonzero(size > k) if k == 8 else rest[size[rest] > k]
            if not len(rest):
                break
        out[rest] = mix64(out[rest] ^ (eights[begin[rest] + k] & _FIRST_BYTES[np.minimum(size[rest] - k, 8)]))
    for x in np.flatnonzero(size > LONG_WORD).tolist():
        out[x] = xxhash.xxh3_64_intdigest(text[begin[x] : begin[x] + size[x]])
    out[out == 0] = 1
    return out


def _bounds(text: bytes, blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the blobs joined by white space: where each word begins and ends, and where each blob's words start (one more than blobs)."""
    data = np.frombuffer(text, np.uint8)
    solid = ~_SPACE[data]
    edge = np.flatnonzero(solid[1:] != solid[:-1]) + 1
    if solid[0]:
        edge = np.concatenate(([0], edge))
    begin, end = edge[0::2], edge[1::2]
    sizes = np.array([len(b) + 1 for b in blobs], np.int64)
    return begin, end, np.searchsorted(begin, np.concatenate(([0], np.cumsum(sizes))))


def split(table: WordTable, blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of all the texts' words in one array, and where each text's words start (one more than texts)."""
    text = b"\n".join(blobs) + b"\n"
    begin, end, starts = _bounds(text, blobs)
    return table.rows(text + PAD, begin, end - begin), starts


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Bytes hashed at a time by word_hashes(); a longer word is hashed by itself.
SEGMENT = 1 << 18
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FACTOR = 0x9E3779B97F4A7C17  # 3 modulo 4
_LETTER = np.random.Generator(np.random.PCG64(7411)).integers(0, 1 << 64, 256, dtype=np.uint64)
_LETTER[65:91] = _LETTER[97:123]  # A-Z as a-z
_powers: list[np.ndarray] = []


def word_hashes(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all the texts' words, with A-Z in lower case, in one array, and where each text's words start (one more than texts).

    A word's hash is a polynomial of its bytes' random numbers, from running sums over the text that are scaled back by
    the inverse power at the word's start; so no word is made an object of its own.
    """
    if not _powers:
        for factor in (_FACTOR, pow(_FACTOR, -1, 1 << 64)):
            x = np.full(SEGMENT, factor, np.uint64)
            x[0] = 1
            _powers.append(np.cumprod(x))
    power, inverse = _powers
    text = b"\n".join(blobs) + b"\n"
    data = np.frombuffer(text, np.uint8)
    begin, end, starts = _bounds(text, blobs)
    out = np.empty(len(begin), np.uint64)
    k = 0
    while k < len(begin):
        a = int(begin[k])
        stop = int(np.searchsorted(end, a + SEGMENT, "right"))
        if stop <= k:
            out[k] = xxhash.xxh3_64_intdigest(data[a : end[k]].tobytes().lower())
            k += 1
            continue
        sums = _LETTER[data[a : end[stop - 1]]]
        sums *= power[: len(sums)]
        np.cumsum(sums, out=sums)
        b, e = begin[k:stop] - a, end[k:stop] - a
        x = sums[e - 1]
        x[1:] -= sums[b[1:] - 1]
        x *= inverse[b]
        x += (e - b).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        out[k:stop] = x
        k = stop
    return mix64(out), starts


def shingles(hashes: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of each text's `width`-word shingles, in order, and where each text's start. A text of fewer words has one: the whole sequence; one without words has none."""
    n = np.diff(starts)
    counts = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    out_starts = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=out_starts[1:])
    total = len(hashes)
    if total >= width:
        roll = np.full(total - width + 1, np.uint64(width), np.uint64)
        for k in range(width):
            roll *= np.uint64(0x9E3779B97F4A7C15)
            roll += hashes[k : total - width + 1 + k]
        roll = mix64(roll)
        owner = np.repeat(np.arange(len(n)), counts)
        at = starts[:-1][owner] + (np.arange(out_starts[-1]) - out_starts[:-1][owner])
        out = roll[np.minimum(at, len(roll) - 1)] if len(roll) else np.zeros(len(at), np.uint64)
    else:
        out = np.zeros(out_starts[-1], np.uint64)
    for d in np.flatnonzero((n > 0) & (n < width)).tolist():
        x = np.uint64(n[d])
        with np.errstate(over="ignore"):
            for h in hashes[starts[d] : starts[d + 1]]:
                x = x * np.uint64(0x9E3779B97F4A7C15) + h
        out[out_starts[d]] = mix64(np.array([x], np.uint64))[0]
    return out, out_starts


def distinct(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct values in ascending order, and where each text's start."""
    parts = []
    counts = np.zeros(len(starts), np.int64)
    for d in range(len(starts) - 1):
        x = np.sort(values[starts[d] : starts[d + 1]])
        if len(x) > 1:
            x = x[np.concatenate(([True], x[1:] != x[:-1]))]
        counts[d + 1] = len(x)
        parts.append(x)
    return np.concatenate(parts) if parts else values[:0], np.cumsum(counts)
