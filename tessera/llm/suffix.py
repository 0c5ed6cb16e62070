"""Removal of repeated 100-byte strings with suffix arrays.

Equal strings of SPAN bytes contain the same least hash of their GRAM-byte substrings, so the runs of window starts with one
least hash are compared among themselves only. Runs that are alone need no work, and runs with the same bytes are merged
before anything is shuffled. The rest is dealt to tasks by their hash and cut into shards of bounded size: each shard gets
a suffix array by Larsson-Sadakane refinement and common prefixes after Kasai, and a shard is merged with the earlier ones
of its hash by binary search in their sorted strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, eight_bytes, in_chunks, mix64, release, text_of

SPAN, GRAM = 100, 16
#: Bytes of a shard of the comparison stage.
SHARD = 1 << 20


def _slide(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """The least (or largest) of each `width` neighbours, by doubling."""
    pick = np.minimum if least else np.maximum
    have, out = 1, x
    while 2 * have <= width:
        out = pick(out[:-have], out[have:])
        have *= 2
    return pick(out[: len(out) - (width - have)], out[width - have :]) if have < width else out


def runs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """(starts, window counts, least hashes, repeats) of the runs of a text; repeats: whether windows of a run may be equal."""
    if len(data) < SPAN:
        return None
    w = eight_bytes(data)
    with np.errstate(over="ignore"):
        h = mix64(w[: len(data) - GRAM + 1] * np.uint64(0x9E3779B97F4A7C15) + mix64(w[8 : len(data) - GRAM + 9]))
    reach = SPAN - GRAM + 1
    m = _slide(h, reach, True)
    change = np.flatnonzero(m[1:] != m[:-1]) + 1
    starts = np.concatenate([[0], change])
    counts = np.diff(np.concatenate([starts, [len(m)]]))
    repeats = np.zeros(len(starts), bool)
    # A gram is the least of some window if it equals the largest of the windows' minima around it; each run has one such
    # gram unless the gram comes again within it.
    wide = np.concatenate([np.zeros(reach - 1, np.uint64), m, np.zeros(reach - 1, np.uint64)])
    least = np.flatnonzero(_slide(wide, reach, False) == h)
    if len(least) > len(starts):
        for i in range(len(starts)):
            a, b = np.searchsorted(least, [starts[i], starts[i] + counts[i] + reach - 1])
            repeats[i] = (h[least[a:b]] == m[starts[i]]).sum() > 1
    return starts, counts, m[starts], repeats


#: Codes packed in one number, nine bits each.
PACK = 7


def packed(codes: np.ndarray) -> np.ndarray:
    """The PACK codes from each place as one number, zeros beyond the end."""
    n = len(codes)
    padded = np.concatenate([codes.astype(np.int64), np.zeros(PACK, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(PACK):
        key = (key << 9) | padded[k : k + n]
    return key


def _sorted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, sorted keys) of keys of up to 42 bits; sorting numbers that hold their places is much faster than sorting places."""
    if len(keys) >= 1 << 21:
        order = np.argsort(keys)
        return order, keys[order]
    both = np.sort(keys << 21 | np.arange(len(keys)))
    return both & ((1 << 21) - 1), both >> 21


def suffix_array(codes: np.ndarray) -> np.ndarray:
    """The starts of the suffixes of codes 0..256 in their order; one that ends first comes first.

    Larsson and Sadakane's scheme: only groups that are not settled are sorted again, by the rank of what follows.
    """
    n = len(codes)
    used = np.bincount(codes, minlength=257) > 0
    used[0] = True  # stands for what is beyond the end
    dense = (np.cumsum(used) - 1)[codes]
    bits = max(1, int(used.sum() - 1).bit_length())
    h = 42 // bits
    padded = np.concatenate([dense, np.zeros(h, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(h):
        key = (key << bits) | padded[k : k + n]
    order, key = _sorted(key)
    first = np.r_[True, key[1:] != key[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    while True:
        slots = np.flatnonzero(~(first & np.r_[first[1:], True]))
        if not len(slots):
            break
        pos = order[slots]
        after = np.where(pos + h < n, rank[np.minimum(pos + h, n - 1)] + 1, 0)
        pair = rank[pos] * (n + 1) + after
        sort, pair = _sorted(pair)
        pos = pos[sort]
        order[slots] = pos
        new = np.r_[True, pair[1:] != pair[:-1]]
        rank[pos] = slots[np.maximum.accumulate(np.where(new, np.arange(len(pos)), 0))]
        first[slots] = new
        h *= 2
    return order


def common_prefixes(codes: np.ndarray, order: np.ndarray, depth: int, stride: int = 16) -> np.ndarray:
    """For each place of `order` the codes shared with the suffix before it, counted up to `depth`.

    Kasai: in text order the count falls by at most one from a suffix to the next. Every `stride`-th suffix is counted from
    nothing and gives the others a count to start from; counting takes PACK codes at a time.
    """
    n = len(codes)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    limit = np.minimum(depth, n - np.maximum(np.arange(n), before))
    limit[before < 0] = 0
    count = np.zeros(n, np.int64)
    key = np.concatenate([packed(codes), np.zeros(depth + PACK, np.int64)])

    def extend(at: np.ndarray) -> None:
        at = at[count[at] < limit[at]]
        while len(at):
            c = count[at]
            apart = key[at + c] ^ key[before[at] + c]
            same = np.full(len(at), PACK)
            some = np.flatnonzero(apart)
            x = apart[some]
            same[some] = sum((x < (1 << (9 * (PACK - k)))).astype(np.int64) for k in range(1, PACK))
            c = np.minimum(c + same, limit[at])
            count[at] = c
            at = at[(same == PACK) & (c < limit[at])]

    extend(np.arange(0, n, stride))
    for k in range(1, stride):
        at = np.arange(k, n, stride)
        count[at] = np.minimum(np.maximum(count[at - 1] - 1, 0), limit[at])
        extend(at)
    return count[order]


def repeated_windows(segments: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, start, class) of all windows of the segments; windows are equal if they have a class in common."""
    sizes = np.array([len(s) for s in segments], np.int64)
    begin = np.cumsum(sizes + 1) - sizes - 1
    codes = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8).astype(np.int16) + 1
    codes[begin + sizes] = 0
    order = suffix_array(codes)
    shared = common_prefixes(codes, order, SPAN)
    windows = np.zeros(len(codes), bool)
    counts = np.maximum(sizes - SPAN + 1, 0)
    at = np.repeat(begin, counts) + np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    windows[at] = True
    group = np.empty(len(codes), np.int64)
    group[order] = np.cumsum(shared < SPAN)
    where = np.searchsorted(begin, at, side="right") - 1
    return where, at - begin[where], group[at]


def _window_keys(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 128-bit key (two numbers in a row) of the window at each place, for the sorted strings of earlier shards."""
    w = eight_bytes(data)
    a, b = np.zeros(len(at), np.uint64), np.full(len(at), 7, np.uint64)
    with np.errstate(over="ignore"):
        for k in [*range(0, SPAN - 7, 8), SPAN - 8]:
            a = mix64(a * np.uint64(0x9E3779B97F4A7C15) + w[at + k])
            b = mix64(b ^ (w[at + k] * np.uint64(0xC2B2AE3D27D4EB4F)))
    return np.rec.fromarrays([a, b], names="a,b")


def _find_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in in_chunks(batch, "t"):
            texts = part.column("t").cast(pa.binary()).to_pylist()
            ids, subs = part.column("id").to_pylist(), part.column("sub").to_pylist()
            rows: list[tuple[np.ndarray, ...]] = []
            prints: list[int] = []
            for i, u, t in zip(ids, subs, texts, strict=True):
                got = runs(np.frombuffer(t, np.uint8))
                if got is None:
                    continue
                starts, counts, least, repeats = got
                view = memoryview(t)
                prints += [xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(starts.tolist(), (starts + counts + SPAN - 1).tolist(), strict=True)]
                rows.append((np.full(len(starts), i), np.full(len(starts), u), starts, counts, least, repeats))
            if not rows:
                continue
            doc, sub, start, count, least, repeats = (np.concatenate(c) for c in zip(*rows, strict=True))
            key, prt = least.view(np.int64), np.array(prints, np.uint64).view(np.int64)
            order = np.lexsort((start, sub, doc, prt, key))
            same = np.zeros(len(order), bool)
            same[order[1:]] = (key[order[1:]] == key[order[:-1]]) & (prt[order[1:]] == prt[order[:-1]])
            # All but the first of runs with the same bytes are repeats; they go straight to their documents.
            gone = same & ~repeats
            dup_key = mix64(doc.view(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_pydict({
                "key": pa.array(np.where(gone, dup_key, key)), "print": pa.array(prt), "doc": pa.array(doc), "sub": pa.array(sub), "start": pa.array(start.astype(np.int32)),
                "n": pa.array(count.astype(np.int32)), "kind": pa.array(np.where(gone, 2, np.where(repeats, 1, 0)).astype(np.int8)),
            })


def _sort_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From runs sorted by (key, doc, start): what is a repeat as a whole (ask false) and what must be compared (ask true).

    Of a key only its distinct prints are held.
    """
    current, known, held, asked = None, {}, None, False
    for batch in batches:
        out: list[tuple[int, int, int, int, int, bool]] = []
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "print", "doc", "sub", "start", "n", "kind")]
        key, prt, doc, sub, start, n, kind = cols
        whole = kind == 2
        for row in zip(key[whole].tolist(), doc[whole].tolist(), sub[whole].tolist(), start[whole].tolist(), n[whole].tolist(), strict=True):
            out.append((*row, False))
        rest = np.flatnonzero(~whole)
        key, prt, doc, sub, start, n, kind = (c[rest] for c in cols)
        if len(key):
            # Most keys have one run, which is read no further unless its own windows may repeat.
            edge = np.r_[True, key[1:] != key[:-1]]
            alone = edge & np.r_[edge[1:], False] & (kind == 0)
            alone[0] &= current != key[0]
            for i in np.flatnonzero(~alone).tolist():
                k, p, d, u, s, c, kd = (int(v[i]) for v in (key, prt, doc, sub, start, n, kind))
                if k != current:
                    current, known, held, asked = k, {}, None, False
                if p in known and kd == 0:
                    if known[p] != (d, u, s):
                        out.append((k, d, u, s, c, False))
                    continue
                known[p] = (d, u, s)
                row = (k, d, u, s, c, True)
                if asked or kd == 1:
                    if held is not None and not asked:
                        out.append(held)
                    out.append(row)
                    asked = True
                elif held is None:
                    held = row
                else:
                    out += [held, row]
                    asked = True
        if out:
            k, d, u, s, c, a = zip(*out, strict=True)
            yield pa.RecordBatch.from_pydict({"key": pa.array(k, pa.int64()), "doc": pa.array(d, pa.int64()), "sub": pa.array(u, pa.int64()), "start": pa.array(s, pa.int32()), "n": pa.array(c, pa.int32()), "ask": pa.array(a, pa.bool_())})


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From segments sorted by (key, doc, start): (doc, start, n) of their windows that an earlier one equals."""
    last, seen = None, np.rec.fromarrays([np.zeros(0, np.uint64)] * 2, names="a,b")

    def shard(rows: list[tuple[int, int, int, int, bytes]]) -> pa.RecordBatch:
        nonlocal last, seen
        segments = [r[4] for r in rows]
        where, start, group = repeated_windows(segments)
        order = np.argsort(group, kind="stable")  # windows come in the order of (key, doc, sub, start)
        later = np.zeros(len(group), bool)
        later[order[1:]] = group[order[1:]] == group[order[:-1]]
        keys = np.array([r[0] for r in rows])
        data = np.frombuffer(b"".join(segments), np.uint8)
        sizes = np.array([len(s) for s in segments], np.int64)
        offset = np.cumsum(sizes) - sizes
        old = np.flatnonzero((keys[where] == last) & ~later) if last is not None and len(seen) else np.zeros(0, np.int64)
        if len(old):
            mine = _window_keys(data, offset[where[old]] + start[old])
            place = np.minimum(np.searchsorted(seen, mine), len(seen) - 1)
            later[old] = seen[place] == mine
        end = int(keys[-1])
        fresh = np.flatnonzero((keys[where] == end) & ~later)
        mine = _window_keys(data, offset[where[fresh]] + start[fresh])
        seen = np.sort(np.concatenate([seen, mine]) if last == end else mine)
        last = end
        hit = np.flatnonzero(later)
        if not len(hit):
            none = pa.array([], pa.int64())
            return pa.RecordBatch.from_pydict({"doc": none, "sub": none, "start": none.cast(pa.int32()), "n": none.cast(pa.int32())})
        cut_at = np.r_[True, (where[hit][1:] != where[hit][:-1]) | (start[hit][1:] != start[hit][:-1] + 1)]
        head = np.flatnonzero(cut_at)
        size = np.diff(np.r_[head, len(hit)])
        own = where[hit[head]]
        docs, subs, begins = (np.array([r[k] for r in rows])[own] for k in (1, 2, 3))
        return pa.RecordBatch.from_pydict({"doc": pa.array(docs), "sub": pa.array(subs), "start": pa.array((begins + start[hit[head]]).astype(np.int32)), "n": pa.array(size.astype(np.int32))})

    rows, size, before = [], 0, None
    for batch in batches:
        for r in zip(*(batch.column(c).to_pylist() for c in ("key", "doc", "sub", "start", "bytes")), strict=True):
            if r[:4] == before:  # a row that repeats a key and a text
                continue
            before = r[:4]
            if size > SHARD:
                yield shard(rows)
                rows, size = [], 0
            rows.append(r)
            size += len(r[4])
    if rows:
        yield shard(rows)


#: Stands for a null key: before all others.
FIRST_KEY = -(1 << 63)


def _documents(df: DataFrame, key: str, text: str) -> DataFrame:
    rows = df.select(F.coalesce(F.col(key).cast("long"), F.lit(FIRST_KEY)).alias("id"), text_of(text).alias("t"))
    return rows.select("id", F.xxhash64("t").alias("sub"), "t")


def repeated_spans(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, sub, start, n): runs of window starts, each of which an earlier window equals, in the UTF-8 bytes of the texts; sub is the text's hash."""
    spark = df.sparkSession
    docs = _documents(df, key, text)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    found = docs.mapInArrow(_find_runs, "key long, print long, doc long, sub long, start int, n int, kind byte")
    sorted_out = cut(found.repartition(n, "key").sortWithinPartitions("key", "doc", "sub", "start").mapInArrow(_sort_out, "key long, doc long, sub long, start int, n int, ask boolean"))
    release(spark)
    asks = sorted_out.where("ask").groupBy(F.col("doc").alias("id"), "sub").agg(F.collect_set(F.struct("key", "start", "n")).alias("asks"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_chunks(batch, "t"):
                keys, ids, subs, starts, parts = [], [], [], [], []
                for d, u, t, asked in zip(part.column("id").to_pylist(), part.column("sub").to_pylist(), part.column("t").cast(pa.binary()).to_pylist(), part.column("asks").to_pylist(), strict=True):
                    for a in asked:
                        keys.append(a["key"])
                        ids.append(d)
                        subs.append(u)
                        starts.append(a["start"])
                        parts.append(t[a["start"] : a["start"] + a["n"] + SPAN - 1])
                yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.int64()), "doc": pa.array(ids, pa.int64()), "sub": pa.array(subs, pa.int64()), "start": pa.array(starts, pa.int32()), "bytes": pa.array(parts, pa.binary())})

    segments = docs.join(asks, ["id", "sub"]).mapInArrow(fetch, "key long, doc long, sub long, start int, bytes binary")
    compared = segments.repartition(n, "key").sortWithinPartitions("key", "doc", "sub", "start").mapInArrow(_compare, "doc long, sub long, start int, n int")
    return sorted_out.where("not ask").select("doc", "sub", "start", "n").unionByName(compared)


def strip_repeats(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, kept (binary: the remaining bytes), n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256.

    A byte goes when some SPAN-byte string that covers it also starts earlier: in a row of a smaller key, or before in the
    same text. Strings are judged on the input. A null text is empty, a null key comes before all others and stays null; a
    key may have several texts, which come in order of their hashes; rows that repeat key and text are one document. Other columns are not read. A text is held
    whole in a task; a key's run of equal hashes is compared in shards.
    """
    marks = repeated_spans(df, key, text).groupBy(F.col("doc").alias("id"), "sub").agg(F.collect_list(F.struct("start", "n")).alias("marks"))
    docs = _documents(df, key, text)
    joined = docs.join(marks, ["id", "sub"], "left").select("id", "t", "marks")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_chunks(batch, "t"):
                kept, sizes, spans = [], [], []
                texts = part.column("t").cast(pa.binary()).to_pylist()
                for t, m in zip(texts, part.column("marks").to_pylist(), strict=True):
                    sizes.append(len(t))
                    n, out, end = 0, [], 0
                    for a, b in sorted((x["start"], x["start"] + x["n"] + SPAN - 1) for x in m or ()):
                        if a > end or (a == 0 and n == 0):
                            out.append(t[end:a])
                            n += 1
                        end = max(end, b)
                    out.append(t[end:])
                    kept.append(b"".join(out))
                    spans.append(n)
                lengths = np.array([len(k) for k in kept], np.int64)
                sizes = np.array(sizes, np.int64)
                yield pa.RecordBatch.from_pydict({
                    key: pa.array([None if i == FIRST_KEY else i for i in part.column("id").to_pylist()], pa.int64()), "kept": pa.array(kept, pa.binary()), "n_bytes": pa.array(sizes), "n_removed": pa.array(sizes - lengths),
                    "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept]),
                })

    return joined.mapInArrow(strip, f"`{key}` long, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
