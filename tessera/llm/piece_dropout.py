"""SentencePiece BPE with seeded merge-dropout, and its decoding.

Merging takes the best-scored adjacent pair first, the leftmost on ties. A candidate merge, named by the word and the
borders of its two halves, is skipped when a keyed hash of it falls below the dropout rate. With rate 0 the ids are those
of the library. A word's key also holds the document and the word's place, so that every occurrence of a word draws anew;
occurrences share their work only where the same candidates of a word are skipped. A run with the same seed repeats
exactly, in whatever task it runs.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import hash_strings, in_chunks, mix64, text_of

SPACE = "▁"
#: The priority of a pair that does not merge.
NEVER = np.int32(2**31 - 1)
#: Candidate merges of a word that are drawn ahead, as bits of a number, and words whose candidates a task remembers.
DRAWN, REMEMBERED = 64, 200_000
#: Words of up to so many characters are merged together in arrays; longer ones by an agenda of their own.
WIDTHS = (8, 16, 32, 64)


class Pieces:
    """A BPE vocabulary: single characters, merges with their priority, and the bytes of each piece."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        usable = [not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)) for i in range(n)]
        if any(ok and re.search(f"[^{SPACE}]{SPACE}", p) for ok, p in zip(usable, names, strict=True)):
            raise ValueError("a piece continues past a word: words can't be encoded one by one")
        self.ids = {p: i for i, p in enumerate(names) if usable[i]}
        self.byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.char_id = np.full(0x110000, -1, np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.char_id[ord(p)] = i
        by_score = np.argsort([-model.get_score(i) for i in range(n)], kind="stable")
        rank = np.empty(n, np.int32)
        rank[by_score] = np.arange(n)
        pairs = {}
        self.splits: dict[str, list[int]] = {}
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                a, b = self.ids.get(p[:k]), self.ids.get(p[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = i
                    self.splits.setdefault(p, []).append(k)
        self.longest = max(map(len, self.splits), default=0)
        self.known: dict[str, list[int] | None] = {}
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int32)
        self.priority = rank[self.merged]
        self.rank = rank
        # A small table answers most look-ups: a slot holds a key and where it is, or must be searched for.
        self.slots = 1 << 20
        slot = self._slot(self.keys)
        self.slot_at = np.full(self.slots, -1, np.int32)
        self.slot_at[slot] = np.arange(len(self.keys))
        self.shared = np.bincount(slot, minlength=self.slots) > 1
        raw = [bytes([int(names[i][1:-1], 16)]) if model.is_byte(i) else b"" if model.is_control(i) else names[i].replace(SPACE, " ").encode() for i in range(n)]
        self.blob = np.frombuffer(b"".join(raw), np.uint8)
        self.sizes = np.array([len(r) for r in raw], np.int64)
        self.offsets = np.cumsum(self.sizes) - self.sizes

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def candidates(self, word: str) -> list[int] | None:
        """The borders (7 bits each) of every merge that can ever be a candidate in a word; None if there are more than DRAWN."""
        if word not in self.known:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            n, at = len(word), None
            if n <= WIDTHS[-1]:
                at = [a << 14 | (a + k) << 7 | e for a in range(n) for e in range(a + 2, min(n, a + self.longest) + 1) for k in self.splits.get(word[a:e], ())]
            self.known[word] = at if at is not None and len(at) <= DRAWN else None
        return self.known[word]

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Where in `keys` each pair is, or -1."""
        key = (left.astype(np.int64) << 32) | right
        slot = self._slot(key)
        at = self.slot_at[slot].astype(np.int64)
        at[(at >= 0) & (self.keys[at] != key)] = -1
        many = np.flatnonzero((at < 0) & self.shared[slot])
        if len(many):
            found = np.minimum(np.searchsorted(self.keys, key[many]), len(self.keys) - 1)
            at[many] = np.where(self.keys[found] == key[many], found, -1)
        at[(left < 0) | (right < 0)] = -1
        return at


def spots(start: np.ndarray, middle: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the borders of candidate merges."""
    with np.errstate(over="ignore"):
        place = (start.astype(np.uint64) * np.uint64(0x100000001B3) + middle.astype(np.uint64)) * np.uint64(0x100000001B3) + end.astype(np.uint64)
        return mix64(place + np.uint64(0x9E3779B97F4A7C15))


def below(word_keys: np.ndarray, spot: np.ndarray, rate: float) -> np.ndarray:
    return mix64(word_keys ^ spot) < np.uint64(min(int(rate * 2**64), 2**64 - 1))


def skipped(word_keys: np.ndarray, start: np.ndarray, middle: np.ndarray, end: np.ndarray, rate: float) -> np.ndarray:
    """Which candidate merges the keyed hash skips."""
    return below(word_keys, spots(start, middle, end), rate) if rate > 0 else np.zeros(len(word_keys), bool)


def alike(p: Pieces, words: list[str], codes: np.ndarray, keys: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """(first, which): an occurrence of each word and set of skipped candidates, and for every occurrence which of these it is."""
    often = np.bincount(codes, minlength=len(words)) > 3  # rare words have little to share
    found = [p.candidates(w) if o else None for w, o in zip(words, often.tolist(), strict=True)]
    size = np.array([len(f) if f is not None else 0 for f in found], np.int64)
    start = np.cumsum(size) - size
    borders = np.fromiter(chain.from_iterable(f for f in found if f is not None), np.int64, int(size.sum()))
    flat = spots(borders >> 14, borders >> 7 & 127, borders & 127)
    alone = np.array([f is None for f in found], bool)[codes]
    drawn = np.zeros(len(codes), np.uint64)
    live = np.flatnonzero(size[codes] > 0)
    for j in range(int(size.max(initial=0))):
        live = live[size[codes[live]] > j]
        drawn[live] |= below(keys[live], flat[start[codes[live]] + j], rate).astype(np.uint64) << np.uint64(j)
    drawn[alone] = np.flatnonzero(alone)
    order = np.lexsort((drawn, codes))
    c, d = codes[order], drawn[order]
    new = np.ones(len(order), bool)
    new[1:] = (c[1:] != c[:-1]) | (d[1:] != d[:-1])
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    return order[new], which


def merge_one(p: Pieces, chars: np.ndarray, key: int, rate: float) -> list[tuple[int, int]]:
    """(symbol, start) of one word of any length, by an agenda."""
    n = len(chars)
    sym = p.char_id[chars].tolist()
    nxt, prv, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    key_array = np.array([key], np.uint64)
    heap: list[tuple[int, int, int, int, int]] = []

    def offer(a: int) -> None:
        b = nxt[a] if a >= 0 else n
        if a < 0 or b >= n or sym[a] < 0 or sym[b] < 0:
            return
        got = p.pairs.get(sym[a] << 32 | sym[b])
        if got is not None and not skipped(key_array, np.array([a]), np.array([b]), np.array([nxt[b]]), rate)[0]:
            heapq.heappush(heap, (int(p.rank[got]), a, b, nxt[b], got))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, a, b, e, got = heapq.heappop(heap)
        if not (alive[a] and b < n and alive[b] and nxt[a] == b and nxt[b] == e):
            continue
        sym[a], nxt[a], alive[b] = got, e, False
        if e < n:
            prv[e] = a
        offer(prv[a])
        offer(a)
    return [(sym[i], i) for i in range(n) if alive[i]]


def merge_many(p: Pieces, chars: np.ndarray, sizes: np.ndarray, keys: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, alive) of words given as rows of characters, padded to one width."""
    w, width = chars.shape
    cols = np.arange(width)
    inside = cols[None, :] < sizes[:, None]
    sym = np.where(inside, p.char_id[chars], -1).astype(np.int32)
    alive = inside.copy()
    nxt = np.broadcast_to(cols + 1, (w, width)).astype(np.int16).copy()
    prv = np.broadcast_to(cols - 1, (w, width)).astype(np.int16).copy()
    prio = np.full((w, width), NEVER, np.int32)
    made = np.zeros((w, width), np.int32)
    n = sizes.astype(np.int64)

    def offer(rows: np.ndarray, a: np.ndarray) -> None:
        b = nxt[rows, a].astype(np.int64)
        prio[rows, a] = NEVER
        ok = b < n[rows]
        rows, a, b = rows[ok], a[ok], b[ok]
        at = p.find(sym[rows, a], sym[rows, b])
        ok = at >= 0
        rows, a, b, at = rows[ok], a[ok], b[ok], at[ok]
        ok = ~skipped(keys[rows], a, b, nxt[rows, b], rate)
        rows, a, at = rows[ok], a[ok], at[ok]
        prio[rows, a] = p.priority[at]
        made[rows, a] = p.merged[at]

    for c in range(width - 1):
        rows = np.flatnonzero(n > c + 1)
        if len(rows):
            offer(rows, np.full(len(rows), c))
    live = np.arange(w)
    while len(live):
        a = prio[live].argmin(axis=1)
        more = prio[live, a] != NEVER
        live, a = live[more], a[more]
        if not len(live):
            break
        b = nxt[live, a].astype(np.int64)
        e = nxt[live, b].astype(np.int64)
        sym[live, a] = made[live, a]
        alive[live, b] = False
        prio[live, b] = NEVER
        nxt[live, a] = e
        ahead = e < n[live]
        prv[live[ahead], e[ahead]] = a[ahead]
        offer(live, a)
        before = prv[live, a].astype(np.int64)
        back = before >= 0
        offer(live[back], before[back])
    return sym, alive


def _utf8(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, sizes) of code points."""
    raw = [chr(c).encode("utf-8", "surrogatepass") for c in points.tolist()]
    return np.frombuffer(b"".join(raw), np.uint8), np.array([len(r) for r in raw], np.int64)


def ragged(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The concatenation of values[start : start + size]."""
    total = int(sizes.sum())
    before = np.cumsum(sizes) - sizes
    return values[np.arange(total) + np.repeat(starts - before, sizes)]


def encode_words(p: Pieces, words: list[str], keys: np.ndarray, rate: float, mark: str = "") -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of words, each already with its leading spaces as U+2581; mark: what stands for a U+2581 of the text itself."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    ends = np.cumsum(sizes)
    own = np.where(chars == ord(mark), ord(SPACE), chars) if mark else chars  # what a symbol that stays unknown is written as
    rows, starts, symbols = [], [], []
    low = 0
    for width in WIDTHS:
        mine = np.flatnonzero((sizes > low) & (sizes <= width))
        low = width
        for part in np.array_split(mine, max(1, -(-len(mine) * width // 4_000_000))):
            if not len(part):
                continue
            cols = np.minimum((ends - sizes)[part][:, None] + np.arange(width), len(chars) - 1)
            sym, alive = merge_many(p, chars[cols], sizes[part], keys[part], rate)
            r, c = np.nonzero(alive)
            rows.append(part[r])
            starts.append(c)
            symbols.append(sym[r, c])
    for i in np.flatnonzero(sizes > WIDTHS[-1]).tolist():
        got = merge_one(p, chars[ends[i] - sizes[i] : ends[i]], int(keys[i]), rate)
        rows.append(np.full(len(got), i))
        starts.append(np.array([s for _, s in got]))
        symbols.append(np.array([s for s, _ in got], np.int32))
    if not rows:
        return np.zeros(0, np.int32), np.zeros(len(words) + 1, np.int64)
    row, start, symbol = np.concatenate(rows), np.concatenate(starts), np.concatenate(symbols)
    order = np.lexsort((start, row))
    row, start, symbol = row[order], start[order], symbol[order]
    count = np.ones(len(row), np.int64)
    lost = np.flatnonzero(symbol < 0)
    data, lengths = _utf8(own[(ends - sizes)[row[lost]] + start[lost]])
    count[lost] = lengths
    ids = np.repeat(symbol, count)
    at = np.cumsum(count) - count
    ids[ragged(np.arange(len(ids)), at[lost], lengths)] = p.byte_ids[data]
    per_word = np.bincount(row, weights=count, minlength=len(words)).astype(np.int64)
    return ids, np.concatenate([[0], np.cumsum(per_word)])


_SPLIT = re.compile(f"{SPACE}+[^{SPACE}]*")


def split_texts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, str]:
    """(code of each word, offsets of the texts, distinct words, mark): a word is spaces and what follows them; last, the character that stands for a text's own U+2581, one that no text has."""
    texts = texts.cast(pa.large_string())
    odd = pc.or_(pc.match_substring(texts, "  "), pc.or_(pc.match_substring_regex(texts, "^ | $"), pc.match_substring(texts, SPACE)))
    plain = pc.split_pattern(texts, " ")
    if not pc.any(odd).as_py():
        flat, offsets = plain.flatten(), plain.offsets.to_numpy().astype(np.int64)
        n_words = np.diff(offsets)
        empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        coded = flat.dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        if empty.any():
            codes = codes[np.repeat(~empty, n_words)]
            n_words = np.where(empty, 0, n_words)
        words = pc.binary_join_element_wise(pa.scalar(SPACE, pa.large_string()), coded.dictionary, pa.scalar("", pa.large_string()))
        return codes, np.concatenate([[0], np.cumsum(n_words)]), words, ""
    known: dict[str, int] = {}
    codes, counts = [], []
    mark = next(c for c in map(chr, range(0x10FFFF, 0xFFFF, -1)) if not pc.any(pc.match_substring(texts, c)).as_py())
    for t in texts.to_pylist():
        found = _SPLIT.findall((SPACE + t.replace(SPACE, mark).replace(" ", SPACE)) if t else "")
        counts.append(len(found))
        codes += [known.setdefault(w, len(known)) for w in found]
    return np.array(codes, np.int64), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64), pa.array(list(known), pa.large_string()), mark


def encode_texts(p: Pieces, texts: pa.Array, text_keys: np.ndarray, rate: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of texts; text_keys: an unsigned number for each text that its draw depends on."""
    codes, offsets, words, mark = split_texts(texts)
    if not len(codes):
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    with np.errstate(over="ignore"):
        count = np.diff(offsets)
        place = np.arange(len(codes)) - np.repeat(offsets[:-1], count)
        secret = mix64(np.array([seed], np.uint64) + np.uint64(0x5EED))[0]
        keys = mix64(hash_strings(pc.replace_substring(words, mark, SPACE) if mark else words)[codes] ^ mix64(np.repeat(mix64(text_keys ^ secret), count) + place.astype(np.uint64)))
    if rate > 0:
        first, which = alike(p, words.to_pylist(), codes, keys, rate)
    else:
        _, first, which = np.unique(codes, return_index=True, return_inverse=True)
    ids, ends = encode_words(p, pc.take(words, pa.array(codes[first])).to_pylist(), keys[first], rate, mark)
    sizes = np.diff(ends)[which]
    out = ragged(ids, ends[:-1][which], sizes)
    total = np.concatenate([[0], np.cumsum(sizes)])
    return out, total[offsets]


def decode_ids(p: Pieces, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts of ids, without the space that encoding puts in front."""
    sizes = p.sizes[ids]
    data = ragged(p.blob, p.offsets[ids], sizes)
    ends = np.concatenate([[0], np.cumsum(sizes)])[offsets]
    some = np.flatnonzero(np.diff(ends) > 0)
    lead = ends[:-1][some]
    keep = np.ones(len(data), bool)
    keep[lead[data[lead] == 32]] = False
    kept = np.concatenate([[0], np.cumsum(keep)])
    return data[keep], kept[ends]


_loaded: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def encode_pieces(df: DataFrame, vocabulary: str, rate: float = 0.1, seed: int = 0, key: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """Per row: key, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit numbers), lossless (the ids decode to the text), and ids (array<int>) with `with_ids`.

    A null or empty text has no ids. A null key counts as 0 in the draw. Rows that repeat key and text get the same ids;
    a repeated text under another key is drawn anew. Other columns are not read. A text of any length is held whole while
    it is encoded, and texts are taken a few megabytes at a time.
    """
    rows = df.select(F.col(key).cast("long").alias(key), text_of(text).alias("__t"))
    schema = f"`{key}` long, n_tokens long, ids_crc32 long, lossless boolean" + ", ids array<int>" * with_ids

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(vocabulary)
        for batch in batches:
            for part in in_chunks(batch, "__t"):
                texts = part.column("__t")
                keys = part.column(key).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                ids, offsets = encode_texts(p, texts, keys, rate, seed)
                data, ends = decode_ids(p, ids, offsets)
                raw, view = data.tobytes(), memoryview(ids.astype("<u4").tobytes())
                o, e = offsets.tolist(), ends.tolist()
                out = {
                    key: part.column(key),
                    "n_tokens": pa.array(np.diff(offsets)),
                    "ids_crc32": pa.array([zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(o, o[1:], strict=False)], pa.int64()),
                    "lossless": pa.array([raw[a:b] == t for a, b, t in zip(e, e[1:], texts.cast(pa.binary()).to_pylist(), strict=False)], pa.bool_()),
                }
                if with_ids:
                    out["ids"] = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_pydict(out)

    return rows.mapInArrow(encode, schema)


def decode_pieces(df: DataFrame, vocabulary: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """df with column `out`, the text of its ids; null ids give a null text, a column named `out` is replaced."""
    @F.pandas_udf("string")
    def decoded(column: pd.Series) -> pd.Series:
        p = pieces(vocabulary)

        def one(row: np.ndarray | None) -> str | None:
            if row is None:
                return None
            data, _ = decode_ids(p, np.asarray(row, np.int64), np.array([0, len(row)]))
            return data.tobytes().decode("utf-8", "replace")

        return column.map(one)

    return df.withColumn(out, decoded(F.col(ids)))
