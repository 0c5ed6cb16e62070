"""Line dedup by an exact set-similarity join.

A line is the set of its lower-case words. Words are ordered by rarity; two sets of similarity t or more share their rarest
common word within the first n - ceil(t n) + 1 words of both, and their second rarest within one word more. So a line is
posted under each of its first words that is not frequent, and under each pair of its first frequent words: whichever word
is the rarest common one, the lines meet, and no key gathers the lines of a frequent word. Lines that meet pass filters on
their lengths, on the places of the shared key and on 128 bits that tell how many words differ at least; each only drops
lines that can't be similar. A line names few earlier candidates for each key, of which those with the most keys are verified
first; the lines for which they fail, and that may have more, look at all of them. Postings of keys that had candidates are
kept for that.

Postings travel packed, a row for a bucket of keys and a chunk of text. Equal lines are merged within a chunk, within a task
as far as they recur, and where they meet. Rarity is kept in a table of fixed size (a byte for a cell of word hashes), so any
number of words fits; words that share a cell only make the order less sharp, never the join less exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, give_back, in_chunks, mix64, release, text_of, word_hashes

THRESHOLD = 0.8
#: Cells of the rarity table, in blocks that are summed apart.
CELLS, BLOCK = 1 << 24, 1 << 18
#: Words of this rank (8 log2 of the occurrences of their cell) or more are frequent: they are posted in pairs.
FREQUENT = 8 * 10
#: Lines with more distinct words post frequent words one by one, apart from those of shorter lines.
LONG = 500
#: Earlier candidates that a line names for each key, and those verified before the rest wait for the outcome.
FIRST, BEST = 4, 2
#: Lines to verify whose numbers are broadcast (about 50 bytes each); more are joined by shuffling.
BROADCAST = 1 << 13
#: Text and pairs of frequent words handled at a time, pairs of lines compared at a time, and sets that a task remembers as recurring.
CHUNK, PAIRS, TILE, RECURRING = 8 << 20, 1 << 20, 1 << 20, 1 << 16
#: Words of lines sorted at a time, and neighbours compared at a time.
SORTED, SLICE = 1 << 16, 1 << 14
#: Longs of 64 bits, in blocks, in which a bit is set for each text that has lines to verify (8 MB in all).
LONGS, PER_BLOCK = 1 << 20, 1 << 10
#: Buckets of keys for each shuffle partition; a task holds one bucket at a time.
SPREAD = 4

PACKED = {"key": "<u4", "same": "<u8", "b1": "<u8", "b2": "<u8", "line": "<u4", "size": "<u4", "place": "<u4", "doc": "<i8", "sub": "<i8"}
POSTED = "bucket int, " + ", ".join(f"{c} binary" for c in PACKED)
NAMED = {"doc": "<i8", "sub": "<i8", "line": "<u4", "doc0": "<i8", "sub0": "<i8", "line0": "<u4", "at": "<u8", "more": "u1"}
FOUND = "kind int, target int, bucket int, at_key long, " + ", ".join(f"{c} binary" for c in PACKED | NAMED)
GONE, CANDIDATES, KEPT = range(3)
ID, ID0 = ["doc", "sub", "line"], ["doc0", "sub0", "line0"]


def _lines(texts: pa.Array, rank: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, line, word hashes, offsets) of the lines of texts that have words; a line's distinct hashes, rarest first if the ranks of the cells are given."""
    split = pc.split_pattern(texts.cast(pa.large_string()), "\n")
    offsets = split.offsets.to_numpy().astype(np.int64)
    words, bounds = word_hashes(split.flatten())
    n = np.diff(bounds)
    hashes, rows = [], []
    ends = np.searchsorted(bounds, np.arange(SORTED, len(words) + SORTED, SORTED))  # of blocks of lines, so that each is sorted in the processor's cache
    for a, b in zip(np.r_[0, ends].tolist(), np.minimum(ends, len(n)).tolist(), strict=False):
        own, row = words[bounds[a] : bounds[b]], np.repeat(np.arange(b - a), n[a:b])
        # One key a word: its line, its rank, and as many bits of its hash as are left.
        bits = max(1, int(b - a).bit_length())
        key = own >> np.uint64(bits)
        if rank is not None:
            key = (key >> np.uint64(8)) | (rank[_cell(own)].astype(np.uint64) << np.uint64(56 - bits))
        order = np.argsort(key | (row.astype(np.uint64) << np.uint64(64 - bits)))
        own, row = own[order], row[order]
        first = np.ones(len(own), bool)
        first[1:] = (own[1:] != own[:-1]) | (row[1:] != row[:-1])
        hashes.append(own[first])
        rows.append(row[first] + a)
    words, row = np.concatenate([*hashes, words[:0]]), np.concatenate([*rows, np.zeros(0, np.int64)])
    some = np.flatnonzero(n > 0)
    bounds = np.r_[np.searchsorted(row, some), len(row)]
    text = np.searchsorted(offsets, some, side="right") - 1
    return text, some - offsets[text], words, bounds


def _cell(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(40)).astype(np.int64)


def _need(threshold: float, sizes: np.ndarray) -> np.ndarray:
    """The least overlap with any similar set."""
    return np.ceil(threshold * sizes - 1e-9).astype(np.int64)


def _pack(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Binary values of the runs of an array between bounds."""
    raw = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * raw.itemsize).astype(np.int32)), pa.py_buffer(raw)])


def _unpack(column: list, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind)


def _dealt(name: str, bucket: np.ndarray, columns: dict[str, np.ndarray], kinds: dict[str, str], **same: int) -> pa.RecordBatch:
    """A row for each bucket, with its values of the columns packed."""
    order = np.argsort(bucket.astype(np.int16) if len(bucket) and bucket.max() < 1 << 15 else bucket, kind="stable")
    b = bucket[order]
    starts = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.zeros(0, np.int64)
    bounds = np.r_[starts, len(b)].astype(np.int64)
    fixed = {c: pa.array(np.full(len(starts), v, np.int32)) for c, v in same.items()}
    return pa.RecordBatch.from_pydict(fixed | {name: pa.array(b[starts].astype(np.int32))} | {c: _pack(columns[c][order].astype(kind), bounds) for c, kind in kinds.items()})


def _rarity(docs: DataFrame, n: int) -> np.ndarray:
    """The rank of each cell (0 to 255): 8 log2 of how often words of the cell occur in all documents; 0 for at most once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.uint32)
        for batch in batches:
            for part in in_chunks(batch, "t"):
                np.add.at(total, _cell(word_hashes(part.column("t"))[0]), np.uint32(1))
        cells = np.flatnonzero(total)
        bounds = np.searchsorted(cells, np.arange(0, CELLS + 1, BLOCK))
        yield pa.RecordBatch.from_pydict({"block": pa.array(np.arange(len(bounds) - 1, dtype=np.int32)), "cells": _pack((cells % BLOCK).astype("<u4"), bounds), "n": _pack(total[cells].astype("<u4"), bounds)})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, cells, counts in zip(batch.column("block").to_pylist(), batch.column("cells").to_pylist(), batch.column("n").to_pylist(), strict=True):
                np.add.at(total.setdefault(block, np.zeros(BLOCK, np.int64)), np.frombuffer(cells, "<u4"), np.frombuffer(counts, "<u4"))
        for block, sums in total.items():
            ranks = np.where(sums > 1, np.minimum(255, np.ceil(np.log2(np.maximum(sums, 1)) * 8)), 0).astype(np.uint8)
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "ranks": pa.array([ranks.tobytes()], pa.binary())})

    summed = docs.select("t").mapInArrow(count, "block int, cells binary, n binary").repartition(min(n, CELLS // BLOCK), "block").mapInArrow(add, "block int, ranks binary")
    table = np.zeros(CELLS, np.uint8)
    for row in summed.collect():  # CELLS bytes in all, by one job
        table[row.block * BLOCK : (row.block + 1) * BLOCK] = np.frombuffer(row.ranks, np.uint8)
    return table


def _keys(words: np.ndarray, bounds: np.ndarray, ranks: np.ndarray, same: np.ndarray, live: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(key, line, place) under which the live lines are posted: first words, pairs of first frequent words, or the whole set if it is similar to no other."""
    sizes = np.diff(bounds)
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(words)) - bounds[:-1][row]
    spare = sizes - _need(threshold, sizes)
    lone = np.floor(sizes / threshold + 1e-9) == sizes
    joins = live & ~lone
    often = ranks >= FREQUENT
    at = np.flatnonzero((place <= spare[row]) & joins[row] & (ranks > 0) & (~often | (sizes >= threshold * LONG)[row]))
    with np.errstate(over="ignore"):
        yield np.where(often[at], mix64(words[at] + np.uint64(1)), words[at]), row[at], place[at]
        alone = np.flatnonzero(live & lone)
        yield same[alone], alone, np.zeros(len(alone), np.int64)
        # Frequent words are the last ones of the order; each goes with those after it.
        at = np.flatnonzero((place <= spare[row] + 1) & joins[row] & often & (sizes <= LONG)[row])
        if not len(at):
            return
        ends = np.searchsorted(row[at], row[at], side="right")
        partners = ends - np.arange(len(at)) - 1
        cells = np.cumsum(partners) // PAIRS
        for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(cells)) + 1):
            a = np.repeat(part, partners[part])
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(partners[part]) - partners[part], partners[part])
            yield mix64(words[at[a]] * np.uint64(0x9E3779B97F4A7C15) + words[at[b]]), row[at[a]], place[at[a]]


class _Recurring:
    """The sets that recurred in a task so far, each with its least line; a bounded number."""

    def __init__(self) -> None:
        self.same = np.zeros(0, np.uint64)
        self.least = np.zeros((3, 0), np.int64)

    def later(self, same: np.ndarray, own: np.ndarray, again: np.ndarray) -> np.ndarray:
        """Which lines (own: doc, sub, line) equal an earlier one that is remembered; lines marked `again` are remembered from now on."""
        out = np.zeros(len(same), bool)
        if len(self.same):
            at = np.minimum(np.searchsorted(self.same, same), len(self.same) - 1)
            hit = np.flatnonzero(self.same[at] == same)
            out[hit] = _less(self.least[:, at[hit]], own[:, hit])
            lower = hit[~out[hit]]
            self.least[:, at[lower]] = own[:, lower]
            again = again.copy()
            again[hit] = False
        new = np.flatnonzero(again)[: max(0, RECURRING - len(self.same))]
        if len(new):
            keys = np.concatenate([self.same, same[new]])
            order = np.argsort(keys, kind="stable")
            self.same, self.least = keys[order], np.concatenate([self.least, own[:, new]], axis=1)[:, order]
        return out


def _less(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the columns of a come before those of b."""
    return (a[0] < b[0]) | ((a[0] == b[0]) & ((a[1] < b[1]) | ((a[1] == b[1]) & (a[2] < b[2]))))


def _postings(docs: DataFrame, rarity, buckets: int, threshold: float) -> DataFrame:
    """Packed postings of all lines by bucket of their keys; bucket -1 has the lines that equal an earlier one of their task."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, memory = rarity.value, _Recurring()
        for batch in batches:
            for part in in_chunks(batch, "t", CHUNK):
                text, line, words, bounds = _lines(part.column("t"), rank)
                if not len(text):
                    continue
                own = np.stack([part.column("id").to_numpy(zero_copy_only=False)[text], part.column("sub").to_numpy(zero_copy_only=False)[text], line])
                sizes = np.diff(bounds)
                with np.errstate(over="ignore"):
                    same = np.add.reduceat(mix64(words), bounds[:-1]) ^ mix64(np.bitwise_xor.reduceat(words, bounds[:-1]) + sizes.astype(np.uint64))
                order = np.lexsort((own[2], own[1], own[0], same))
                twin = np.r_[False, same[order[1:]] == same[order[:-1]]]
                later, again = np.zeros(len(order), bool), np.zeros(len(order), bool)
                # Rows that repeat a key and a text are one document: none of their lines is later than the other's.
                head = order[np.maximum.accumulate(np.where(twin, 0, np.arange(len(order))))]
                differs = (own[:, order] != own[:, head]).any(axis=0)
                later[order] = differs
                extra = np.zeros(len(order), bool)
                extra[order] = twin & ~differs
                again[order] = np.r_[twin[1:], False] & ~twin
                kept = np.flatnonzero(~later & ~extra)
                later[kept] = memory.later(same[kept], own[:, kept], again[kept])
                mark, high = np.uint64(1) << (words & np.uint64(63)), words & np.uint64(64) > 0
                bits = {"b1": np.bitwise_xor.reduceat(np.where(high, np.uint64(0), mark), bounds[:-1]), "b2": np.bitwise_xor.reduceat(np.where(high, mark, np.uint64(0)), bounds[:-1])}
                at = lambda r, key, place: {"key": key, "same": same[r], "line": line[r], "size": sizes[r], "place": place, "doc": own[0][r], "sub": own[1][r]} | {c: v[r] for c, v in bits.items()}
                if (gone := np.flatnonzero(later)).size:
                    none = np.zeros(len(gone), np.int64)
                    yield _dealt("bucket", none - 1, at(gone, none, none), PACKED)
                for key, r, place in _keys(words, bounds, rank[_cell(words)], same, ~later & ~extra, threshold):
                    bucket = (key % np.uint64(buckets)).astype(np.int64)
                    if len(key):
                        yield _dealt("bucket", bucket, at(r, key >> np.uint64(32), place), PACKED)

    return docs.mapInArrow(emit, POSTED)


def _repeats(*columns: np.ndarray) -> np.ndarray:
    """Whether each row equals the one before."""
    out = np.ones(len(columns[0]), bool)
    out[:1] = False
    for c in columns:
        out[1:] &= c[1:] == c[:-1]
    return out


def _by_set(key: np.ndarray, size: np.ndarray, same: np.ndarray) -> np.ndarray:
    """The order of rows by key, size and `same`; rows equal in all three stand in any order."""
    if not len(size) or size.max() >= 1 << 12:
        return np.lexsort((same, size, key))
    # One number a row, with as many bits of `same` as are left.
    brief = (key.astype(np.uint64) << np.uint64(32)) | (size.astype(np.uint64) << np.uint64(20)) | (same >> np.uint64(44))
    order = np.argsort(brief)
    even = _repeats(brief[order])
    if (even[1:] & (same[order[1:]] != same[order[:-1]])).any():
        tied = np.flatnonzero(even | np.r_[even[1:], False])
        own = order[tied]
        order[tied] = own[np.lexsort((same[own], brief[own]))]
    return order


class _Bucket:
    """The postings of one bucket in order of (key, size); equal sets of a key stand as their earliest line."""

    def __init__(self, columns: dict[str, list], threshold: float) -> None:
        rows = {c: _unpack(columns[c], kind) for c, kind in PACKED.items()}
        marks = rows["size"] == 0  # lines that the second round asks for
        self.asked = {c: rows[c][marks] for c in ("key", "doc", "sub", "line")}
        if marks.any():
            rows = {c: v[~marks] for c, v in rows.items()}
        both = (rows["key"].astype(np.uint64) << np.uint64(32)) | rows["size"]
        order = _by_set(rows["key"], rows["size"], rows["same"])
        twin = _repeats(both[order], rows["same"][order])
        some = np.flatnonzero(twin | np.r_[twin[1:], False])  # lines with equals under their key, the earliest first
        if len(some):
            own = order[some]
            order[some] = own[np.lexsort((rows["line"][own], rows["sub"][own], rows["doc"][own], rows["same"][own], both[own]))]
        head = order[np.maximum.accumulate(np.where(twin, 0, np.arange(len(order))))] if len(order) else order
        differs = np.zeros(len(order), bool)
        for c in ID:
            differs |= rows[c][order] != rows[c][head]
        gone = order[differs & (rows["place"][order] == 0)]
        self.gone = {c: rows[c][gone] for c in ID}
        kept = order[~twin]
        self.rows, self.both = {c: v[kept] for c, v in rows.items()}, both[kept]
        self.size, self.place = self.rows["size"].astype(np.int64), self.rows["place"].astype(np.int64)
        self.threshold = threshold
        # A set's part of the words in which it may differ from a similar one.
        self.spare = self.size * ((1 - threshold) / (1 + threshold)) + 1e-9
        key = self.both & np.uint64(0xFFFFFFFF00000000)
        least, most = _need(threshold, self.size), np.floor(self.size / threshold + 1e-9).astype(np.int64)
        self.lo = np.searchsorted(self.both, key | least.astype(np.uint64))
        self.hi = np.searchsorted(self.both, key | most.astype(np.uint64), side="right")

    def near(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The places of the pairs of which no filter tells that they can't be similar."""
        r = self.rows
        out = np.flatnonzero(np.bitwise_count(r["b1"][x] ^ r["b1"][y]) + np.bitwise_count(r["b2"][x] ^ r["b2"][y]) <= self.spare[x] + self.spare[y])
        return out[self.placed(x[out], y[out])]

    def placed(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether the words up to the shared key and those after it may be enough in common."""
        return np.minimum(self.place[x], self.place[y]) + np.minimum(self.size[x] - self.place[x], self.size[y] - self.place[y]) >= np.ceil(self.threshold / (1 + self.threshold) * (self.size[x] + self.size[y]) - 1e-9)

    def at_distance(self, d: int, alive: np.ndarray) -> np.ndarray:
        """The lines x of the pairs (x, x + d) that `near` lets pass and of which one is alive; for many, without gathering."""
        b1, b2, n, out = self.rows["b1"], self.rows["b2"], len(self.size), []
        for a in range(0, n - d, SLICE):
            x, y = slice(a, min(a + SLICE, n - d)), slice(a + d, min(a + SLICE + d, n))
            ok = np.bitwise_count(b1[x] ^ b1[y]) + np.bitwise_count(b2[x] ^ b2[y]) <= self.spare[x] + self.spare[y]
            out.append(np.flatnonzero(ok & (alive[x] | alive[y])) + a)
        x = np.concatenate([np.zeros(0, np.int64), *out])
        return x[self.placed(x, x + d)]

    def earlier(self, y: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Whether y is earlier than x."""
        return _less([self.rows[c][y] for c in ID], [self.rows[c][x] for c in ID])

    def passes(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The places of the pairs with y earlier than x of which no filter tells that they can't be similar."""
        out = self.near(x, y)
        return out[self.earlier(y[out], x[out])]

    def first(self, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(line, earlier line, more): for each line up to `most` candidates, those of like size first, and whether there may be more."""
        n, found = len(self.size), np.zeros(len(self.size), np.int64)
        left, right = [], []
        live, d = np.flatnonzero(self.hi - self.lo > 1), 1
        alive = np.zeros(n, bool)
        alive[live] = True
        while len(live) > 16:
            # Each pair at a distance of d once, whichever of its lines is the earlier.
            if len(live) > n >> 5:
                x = self.at_distance(d, alive)
            else:
                x = np.sort(np.concatenate([live[live < n - d], live[live >= d] - d]))
                x = x[~_repeats(x)]
                x = np.concatenate([part[self.near(part, part + d)] for part in np.array_split(x, len(x) // TILE + 1)])
            y = x + d
            before, after = self.earlier(x, y) & (x >= self.lo[y]), self.earlier(y, x) & (y < self.hi[x])
            for line, other in ((y[before], x[before]), (x[after], y[after])):
                ok = alive[line] & (found[line] < most)
                left.append(line[ok])
                right.append(other[ok])
                found[line[ok]] += 1
            d += 1
            stay = (found[live] < most) & ((live - d >= self.lo[live]) | (live + d < self.hi[live]))
            alive[live[~stay]] = False
            live = live[stay]
        # The few that are left, such as the earliest line of a large group, go through their range at once.
        for x in live.tolist():
            for a in range(self.lo[x], self.hi[x], TILE):
                y = np.arange(a, min(a + TILE, self.hi[x]))
                y = y[np.abs(y - x) >= d]
                y = y[self.passes(np.full(len(y), x), y)]
                y = y[np.argsort(np.abs(y - x), kind="stable")][: most - found[x]]
                left.append(np.full(len(y), x))
                right.append(y)
                found[x] += len(y)
                if found[x] >= most:
                    break
        i, j = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (left, right))
        return i, j, found[i] >= most

    def every(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """All candidates of the lines that were asked for."""
        has = np.flatnonzero(np.isin(self.rows["doc"], self.asked["doc"]))
        number = _number(*(np.concatenate([self.asked[c], self.rows[c][has]]) for c in ("key", *ID)))[0]
        asked = len(self.asked["key"])
        lines = has[np.isin(number[asked:], number[:asked])]
        parts = -(-(self.hi - self.lo)[lines] // TILE)  # of their ranges
        x = np.repeat(lines, parts)
        a = self.lo[x] + TILE * (np.arange(len(x)) - np.repeat(np.cumsum(parts) - parts, parts))
        width = np.minimum(TILE, self.hi[x] - a)
        for part in np.split(np.arange(len(x)), np.flatnonzero(np.diff(np.cumsum(width) // TILE)) + 1):
            i = np.repeat(x[part], width[part])
            y = np.repeat(a[part] - np.cumsum(width[part]) + width[part], width[part]) + np.arange(len(i))
            ok = self.passes(i, y)
            yield i[ok], y[ok], np.zeros(len(ok), bool)


def _home(doc: np.ndarray, sub: np.ndarray, n: int) -> np.ndarray:
    """The partition in which all that is found about a line's document meets."""
    return (mix64(doc.astype(np.int64).view(np.uint64) ^ mix64(sub.astype(np.int64).view(np.uint64))) % np.uint64(n)).astype(np.int64)


def _candidates(threshold: float, every: bool, n: int):
    """Reads packed postings in order of buckets, and deals out to n homes the lines known to go and the pairs that pass the filters; postings of keys with candidates are kept."""

    def full(batch: pa.RecordBatch) -> pa.RecordBatch:
        kinds = dict.fromkeys(("kind", "target", "bucket"), pa.int32()) | {"at_key": pa.int64()} | dict.fromkeys(PACKED | NAMED, pa.binary())
        null = {c: pa.nulls(batch.num_rows, kind) for c, kind in kinds.items()}
        return pa.RecordBatch.from_pydict(null | {c: batch.column(c) for c in batch.schema.names})

    def gone(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
        return full(_dealt("target", _home(rows["doc"], rows["sub"], n), rows, {c: NAMED[c] for c in ID}, kind=GONE))

    def compare(bucket: int, columns: dict[str, list]) -> Iterator[pa.RecordBatch]:
        if bucket < 0:
            yield gone({c: _unpack(columns[c], PACKED[c]) for c in ID})
            return
        met = _Bucket(columns, threshold)
        if not every and len(met.gone["doc"]):
            yield gone(met.gone)
        r, held = met.rows, np.zeros(len(met.size), bool)
        for i, j, more in met.every() if every else [met.first(FIRST)]:
            if len(i):
                names = {c: r[c][i] for c in ID} | {c: r[c[:-1]][j] for c in ID0} | {"at": (np.uint64(bucket) << np.uint64(32)) | r["key"][i].astype(np.uint64), "more": more}
                yield full(_dealt("target", _home(r["doc"][i], r["sub"][i], n), names, NAMED, kind=CANDIDATES))
                held[i[more]] = True
        if not every and held.any():  # a row for each key of which a line may have more candidates
            keep = np.flatnonzero(np.isin(r["key"], np.unique(r["key"][held])))
            key = r["key"][keep]
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            bounds = np.r_[starts, len(key)].astype(np.int64)
            fixed = {c: pa.array(np.full(len(starts), v, np.int32)) for c, v in (("kind", KEPT), ("bucket", bucket))}
            yield full(pa.RecordBatch.from_pydict(fixed | {"at_key": pa.array((np.int64(bucket) << 32) | key[starts].astype(np.int64))} | {c: _pack(r[c][keep].astype(kind), bounds) for c, kind in PACKED.items()}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, {c: [] for c in PACKED}
        for batch in batches:
            own = batch.column("bucket").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else []
            for a, b in zip(cuts, [*cuts[1:], len(own)], strict=True):
                if bucket is not None and (own[a] != bucket or bucket < 0):
                    yield from compare(bucket, held)
                    held = {c: [] for c in PACKED}
                bucket = int(own[a])
                for c in PACKED:
                    held[c].extend(batch.column(c).slice(a, b - a).to_pylist())
        if bucket is not None:
            yield from compare(bucket, held)
        held.clear()
        give_back()

    return run


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From packed rows of one home: lines known to go (no earlier line named), and each other line's pairs, `best` for those under the most keys; `keys`, with its first pair, are those that may have more.

    `best` is stored, not compared for where pairs are read: a comparison over a stored table makes Spark build Bloom filters
    for the joins with the sets, which drop nothing there, are merged by one task and go out with every task from the driver.
    """
    held = {(k, c): [] for k in (GONE, CANDIDATES) for c in NAMED}
    for batch in batches:
        kind = batch.column("kind").to_numpy(zero_copy_only=False)
        for k in (GONE, CANDIDATES):
            rows = batch.take(pa.array(np.flatnonzero(kind == k)))
            for c in ID if k == GONE else NAMED:
                held[k, c].extend(rows.column(c).to_pylist())
    gone = {c: _unpack(held[GONE, c], NAMED[c]) for c in ID}
    r = {c: _unpack(held[CANDIDATES, c], NAMED[c]) for c in NAMED}
    line, names = _number(*(np.concatenate([gone[c], r[c]]) for c in ID))
    known = np.zeros(len(names), bool)
    known[line[: len(gone["doc"])]] = True
    own = line[len(gone["doc"]) :]

    def out(at: np.ndarray, ends: dict, best: np.ndarray, keys: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"doc": pa.array(names[at, 0]), "sub": pa.array(names[at, 1]), "line": pa.array(names[at, 2].astype(np.int32))} | ends | {"best": pa.array(best), "keys": keys})

    at = np.flatnonzero(known)
    yield out(at, {c: pa.nulls(len(at), pa.int32() if c == "line0" else pa.int64()) for c in ID0}, np.ones(len(at), bool), pa.nulls(len(at), pa.list_(pa.int64())))
    rest = np.flatnonzero(~known[own])
    if not len(rest):
        return
    own, r = own[rest], {c: v[rest] for c, v in r.items()}
    pair, ends = _number(own, *(r[c] for c in ID0))
    order = np.lexsort((-np.bincount(pair, minlength=len(ends)), ends[:, 0]))
    ends = ends[order]
    head = np.r_[True, ends[1:, 0] != ends[:-1, 0]]
    nth = np.arange(len(ends)) - np.maximum.accumulate(np.where(head, np.arange(len(ends)), 0))
    more = r["more"] > 0
    places, keys = _number(own[more], r["at"][more].view(np.int64))[1].reshape(-1, 2).T
    first, last = np.searchsorted(places, ends[:, 0]), np.searchsorted(places, ends[:, 0], side="right")
    lists = [keys[a:b] if h and b > a else None for h, a, b in zip(head.tolist(), first.tolist(), last.tolist(), strict=True)]
    yield out(ends[:, 0], {"doc0": pa.array(ends[:, 1]), "sub0": pa.array(ends[:, 2]), "line0": pa.array(ends[:, 3].astype(np.int32))}, nth < BEST, pa.array(lists, pa.list_(pa.int64())))


def _number(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each row, the distinct rows in order)."""
    rows = np.stack([c.astype(np.int64) for c in columns], axis=1)
    order = np.lexsort(rows.T[::-1])
    sorted_ = rows[order]
    new = np.r_[True, (sorted_[1:] != sorted_[:-1]).any(axis=1)] if len(order) else np.zeros(0, bool)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return number, sorted_[new]


def _asked(lines: DataFrame) -> DataFrame:
    """Open lines (ID, at) as postings of size 0."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, at = batch.num_rows, batch.column("at").to_numpy(zero_copy_only=False)
            values = {c: batch.column(c).to_numpy(zero_copy_only=False) if c in ID else np.zeros(n, np.int64) for c in PACKED} | {"key": at & 0xFFFFFFFF}
            yield pa.RecordBatch.from_pydict({"bucket": pa.array((at >> 32).astype(np.int32))} | {c: _pack(v.astype(PACKED[c]), np.arange(n + 1)) for c, v in values.items()})

    return lines.mapInArrow(emit, POSTED)


def _may_be_in(docs: DataFrame, ends: DataFrame, n: int) -> DataFrame:
    """The docs without most of those whose (id, sub) ends lacks: by a table of bits, of a fixed size, that all tasks get."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            at = batch.column("at").to_numpy(zero_copy_only=False)
            block = at // (64 * PER_BLOCK)
            for b in np.unique(block).tolist():
                own = at[block == b] % (64 * PER_BLOCK)
                np.bitwise_or.at(blocks.setdefault(b, np.zeros(PER_BLOCK, np.uint64)), own // 64, np.uint64(1) << (own % 64).astype(np.uint64))
        for b, bits in blocks.items():
            yield pa.RecordBatch.from_pydict({"block": pa.array([b], pa.int64()), "bits": pa.array([bits.view(np.int64)], pa.list_(pa.int64()))})

    at = F.xxhash64("id", "sub").bitwiseAND(64 * LONGS - 1)
    block = F.floor(F.col("at") / (64 * PER_BLOCK)).cast("long")
    bits = ends.select(at.alias("at")).repartition(n, block).mapInArrow(fill, "block long, bits array<long>")
    bit = F.call_function("shiftrightunsigned", F.get("bits", (F.shiftright("at", 6) % PER_BLOCK).cast("int")), (F.col("at") % 64).cast("int"))
    return docs.withColumn("at", at).withColumn("block", block).join(F.broadcast(bits), "block").where(bit.bitwiseAND(1) == 1).select(docs.columns)


def _sets(docs: DataFrame, lines: DataFrame, n: int) -> DataFrame:
    """(ID, words) of lines (ID): their word hashes. Few lines go out to the texts, for many both are shuffled, but of the texts only those that may have any."""
    ends = cut(lines.groupBy(F.col("doc").alias("id"), "sub").agg(F.collect_set("line").alias("wanted")))
    few = ends.agg(F.sum(F.size("wanted")).alias("n")).first().n or 0
    texts = docs.join(F.broadcast(ends), ["id", "sub"]) if few <= BROADCAST else _may_be_in(docs, ends, n).join(ends.hint("shuffle_hash"), ["id", "sub"])
    # Only the lines that are wanted go on, numbered as they come.
    some = F.transform(F.array(F.split("t", "\n")), lambda all_: F.transform("wanted", lambda i: F.get(all_, i)))[0]
    texts = texts.select("id", "sub", "wanted", F.array_join(some, "\n").alias("t"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_chunks(batch, "t"):
                text, nth, words, bounds = _lines(part.column("t"))
                wanted = part.column("wanted")
                base = wanted.offsets.to_numpy().astype(np.int64)
                line = wanted.values.to_numpy()[base[:-1][text] + nth]
                yield pa.RecordBatch.from_pydict({"doc": part.column("id").take(pa.array(text)), "sub": part.column("sub").take(pa.array(text)), "line": pa.array(line), "words": pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(words.view(np.int64)))})

    return cut(texts.mapInArrow(emit, "doc long, sub long, line int, words array<long>").groupBy(*ID).agg(F.first("words").alias("words")))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.inline(F.array(F.struct(*ID), F.struct(*[F.col(b).alias(a) for a, b in zip(ID, ID0, strict=True)]))))


def _similar(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The lines (ID) of pairs whose word sets are similar."""
    other = sets.select(*[F.col(a).alias(b) for a, b in zip(ID, ID0, strict=True)], F.col("words").alias("words0"))
    both = pairs.select(*ID, *ID0).join(sets, ID).join(other, ID0).withColumn("common", F.size(F.array_intersect("words", "words0")))
    return both.where(F.col("common") >= threshold * (F.size("words") + F.size("words0") - F.col("common")) - 1e-9).select(*ID).distinct()


def later_lines(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc, sub, line): the lines, counted from 0, that are similar to an earlier one; sub is the hash of the text.

    Earlier are the lines of a smaller key, those further up in the same text, and, if a key has several texts, those of the
    text with the smaller hash. Rows that repeat both key and text are one document.
    """
    spark = df.sparkSession
    docs = df.select(F.col(key).cast("long").alias("id"), text_of(text).alias("t")).where("id is not null").select("id", F.xxhash64("t").alias("sub"), "t")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rarity = spark.sparkContext.broadcast(_rarity(docs, n))
    dealt = lambda p: p.repartition(n, F.when(F.col("bucket") >= 0, F.col("bucket")).otherwise(F.spark_partition_id())).sortWithinPartitions("bucket")
    home = lambda f: f.where(F.col("kind") != KEPT).select("kind", "target", *NAMED).repartition(n, "target").mapInArrow(_choose, "doc long, sub long, line int, doc0 long, sub0 long, line0 int, best boolean, keys array<long>")
    found = cut(dealt(_postings(docs, rarity, n * SPREAD, threshold)).mapInArrow(_candidates(threshold, False, n), FOUND))
    release(spark)
    chosen = cut(home(found))
    pairs = chosen.where("doc0 is not null")
    sets = _sets(docs, _ends(pairs), n)
    gone = cut(chosen.where("doc0 is null").select(*ID).unionByName(_similar(pairs.where("best"), sets, threshold)))
    release(spark)
    # Lines whose best candidates failed: first the others that they named, then all of their keys that may have more.
    others = pairs.where("not best").join(gone, ID, "left_anti")
    gone = cut(gone.unionByName(_similar(others, sets, threshold)))
    open_lines = cut(pairs.where("keys is not null").join(gone, ID, "left_anti").select(*ID, F.explode("keys").alias("at")))
    keys = open_lines.select(F.col("at").alias("at_key")).distinct()
    count = keys.count()
    if not count:
        return gone
    kept = found.where(F.col("kind") == KEPT).select("at_key", "bucket", *PACKED).join(F.broadcast(keys) if count <= BROADCAST else keys, "at_key", "left_semi").drop("at_key")
    rest = dealt(kept.unionByName(_asked(open_lines))).mapInArrow(_candidates(threshold, True, n), FOUND)
    rest = cut(home(rest).select(*ID, *ID0).join(chosen, [*ID, *ID0], "left_anti"))
    fresh = cut(_ends(rest).distinct().join(sets, ID, "left_anti"))
    if not fresh.isEmpty():
        sets = sets.unionByName(_sets(docs, fresh, n))
    return cut(gone.unionByName(_similar(rest, sets, threshold)).distinct())


def dedup_lines(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """df with its repeated lines taken out of `text`, and columns n_lines and n_removed.

    A line goes when the Jaccard similarity of its set of words to that of any earlier line is `threshold` or more, whether
    or not the earlier line stays. Words are lower-case runs without white space; lines end at a line feed; a line without
    words always stays. A null text stays null, with one line; a row with a null key stays as it is. A key may have several
    texts: each is a document of its own, in order of the texts' hashes; rows that repeat key and text are one document and
    lose the same lines. Columns named as the outputs are replaced, others stay.
    """
    lost = later_lines(df, key, text, threshold).groupBy("doc", "sub").agg(F.collect_list("line").alias("lost"))
    rest = [c for c in df.columns if c not in ("n_lines", "n_removed")]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), F.col(key).cast("long").alias("doc"), F.xxhash64(text_of(text)).alias("sub"))
    joined = rows.join(lost.hint("shuffle_hash"), ["doc", "sub"], "left")
    t = F.col("row").getField(text)
    kept = F.transform(F.array(F.split(t, "\n")), lambda all_: F.transform(F.array_except(F.sequence(F.lit(0), F.size(all_) - 1), "lost"), lambda i: F.get(all_, i)))[0]
    stripped = F.when(F.col("lost").isNull(), t).otherwise(F.array_join(kept, "\n"))
    n_lines = F.octet_length(t) - F.octet_length(F.replace(t, F.lit("\n"), F.lit(""))) + 1
    out = [(stripped if c == text else F.col("row").getField(c)).alias(c) for c in rest]
    return joined.select(*out, F.coalesce(n_lines, F.lit(1)).cast("long").alias("n_lines"), F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias("n_removed"))
