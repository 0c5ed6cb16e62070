"""Token ids as files of Simple-8b words.

A shard file holds the ids of consecutive documents:

    magic "TS8B", version (uint32), documents (uint64), ids (uint64), words (uint64), blocks (uint64)
    doc_id of each document (int64), ids of each document (uint64)
    first word of each block (uint64)
    words (uint64)

all little-endian. A block has BLOCK ids (the last may have fewer) and starts with a fresh word, so blocks decode
independently. A word has its selector in the top four bits and its ids from the low bits up. Selector 15 is an escape:
the next word is one id in full, which serves ids of more than 60 bits.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, in_chunks, scratch, text_of

#: Ids a word for each selector; with 60 data bits each id has 60 // n bits.
COUNTS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
BITS = 60 // COUNTS
ESCAPE = 15
BLOCK = 256
HEADER = struct.Struct("<4sIQQQQ")
MAGIC, VERSION = b"TS8B", 1


#: The bits of every 16-bit number.
_SHORT = np.array([i.bit_length() for i in range(1 << 16)], np.uint8)


def bit_lengths(values: np.ndarray) -> np.ndarray:
    """The bits of unsigned 64-bit numbers."""
    if not len(values) or int(values.max()) < 1 << 16:
        return _SHORT[values.astype(np.uint16)]
    out = np.zeros(len(values), np.uint8)
    for shift in (0, 16, 32, 48):
        part = ((values >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)
        out = np.where(part > 0, _SHORT[part] + np.uint8(shift), out)
    return out


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, first word of each block) of unsigned ids.

    Every word takes the largest count whose ids all fit. All blocks advance together, one word at a time.
    """
    ids = ids.astype(np.uint64, copy=False)
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    padded = np.zeros(blocks * BLOCK + 60, np.uint64)
    padded[:n] = ids
    length = bit_lengths(padded)
    # best[i]: the selector of a word that starts at i. Places beyond the end count as 0 bits, and a block's end cuts the word.
    best = np.full(len(padded), ESCAPE, np.uint8)
    top = length[: blocks * BLOCK].copy()
    width = 1
    for s, (count, bits) in enumerate(zip(COUNTS, BITS, strict=True)):
        for k in range(width, count):
            np.maximum(top, length[k : k + blocks * BLOCK], out=top)
        width = int(count)
        fits = top <= bits
        best[: blocks * BLOCK][fits] = s
        if not (top <= BITS[s + 1]).any() if s + 1 < len(BITS) else True:
            break
    at = np.arange(blocks) * BLOCK
    end = np.minimum(at + BLOCK, n)
    live, order, parts, owner = np.arange(blocks), 0, [], []
    counts_of = np.concatenate([COUNTS, [1, 1]])
    while len(live):
        pos = at[live]
        sel = best[pos].astype(np.int64)
        word = sel.astype(np.uint64) << np.uint64(60)
        for s in np.unique(sel):
            mine = np.flatnonzero(sel == s)
            if s == ESCAPE:
                continue
            bits = np.uint64(BITS[s])
            p, stop = pos[mine], end[live[mine]]
            acc = np.zeros(len(mine), np.uint64)
            for k in range(COUNTS[s]):
                value = np.where(p + k < stop, padded[p + k], np.uint64(0))
                acc |= value << (bits * np.uint64(k))
            word[mine] |= acc
        parts.append(word)
        owner.append(live * (2 * BLOCK) + order)
        order += 1
        if (sel == ESCAPE).any():
            e = np.flatnonzero(sel == ESCAPE)
            parts.append(padded[pos[e]])
            owner.append(live[e] * (2 * BLOCK) + order)
        order += 1
        at[live] += counts_of[sel]
        live = live[at[live] < end[live]]
    keys = np.concatenate(owner)
    place = np.argsort(keys, kind="stable")
    words = np.concatenate(parts)[place]
    firsts = np.searchsorted(keys[place], np.arange(blocks) * (2 * BLOCK)).astype(np.uint64)
    return words, firsts


def unpack(words: np.ndarray, firsts: np.ndarray, n: int) -> np.ndarray:
    """The n ids of the words."""
    if not n:
        return np.zeros(0, np.uint64)
    sel = (words >> np.uint64(60)).astype(np.int64)
    # The word after an escape is data. Escapes that follow each other are rare: they are settled from the left.
    raw = np.zeros(len(words), bool)
    marks = np.flatnonzero(sel == ESCAPE)
    for m in marks:
        if not raw[m]:
            raw[m + 1] = True
    head = np.flatnonzero(~raw)
    sel = sel[head]
    size = np.concatenate([COUNTS, [1, 1]])[sel]
    block = np.searchsorted(firsts, head.astype(np.uint64), side="right") - 1
    total = np.cumsum(size)
    base = np.concatenate([[0], total])[:-1]
    first_head = np.searchsorted(head, firsts.astype(np.int64))
    start = base - base[first_head][block] + block * BLOCK
    limit = np.minimum((block + 1) * BLOCK, n)
    out = np.zeros(n, np.uint64)
    for s in np.unique(sel):
        mine = np.flatnonzero(sel == s)
        if s == ESCAPE:
            out[start[mine]] = words[head[mine] + 1]
            continue
        bits = int(BITS[s])
        mask = np.uint64((1 << bits) - 1)
        w = words[head[mine]]
        for k in range(COUNTS[s]):
            there = start[mine] + k
            ok = there < limit[mine]
            out[there[ok]] = ((w >> np.uint64(bits * k)) & mask)[ok]
    return out


def write_shard(filesystem: fs.FileSystem, path: str, doc_ids: np.ndarray, counts: np.ndarray, chunks: list[tuple[np.ndarray, int]]) -> int:
    """Write one shard; chunks: packed (words, firsts, ids) whose ids end on block borders, but for the last. Returns the ids written."""
    total = int(sum(n for _, _, n in chunks))
    words = sum(len(w) for w, _, _ in chunks)
    shift, firsts = 0, []
    for w, f, _ in chunks:
        firsts.append(f + np.uint64(shift))
        shift += len(w)
    with filesystem.open_output_stream(path) as out:
        out.write(HEADER.pack(MAGIC, VERSION, len(doc_ids), total, words, sum(map(len, firsts))))
        out.write(doc_ids.astype("<i8").tobytes())
        out.write(counts.astype("<u8").tobytes())
        for f in firsts:
            out.write(f.astype("<u8").tobytes())
        for w, _, _ in chunks:
            out.write(w.astype("<u8").tobytes())
    return total


def read_shard(filesystem: fs.FileSystem, path: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(doc_ids, counts, ids) of a shard, in runs of whole documents of about a million ids."""
    with filesystem.open_input_file(path) as f:
        magic, version, docs, _, words, blocks = HEADER.unpack(f.read(HEADER.size))
        if magic != MAGIC or version != VERSION:
            raise ValueError(f"{path}: not a shard of token ids")
        doc_ids = np.frombuffer(f.read(8 * docs), "<i8")
        counts = np.frombuffer(f.read(8 * docs), "<u8").astype(np.int64)
        firsts = np.frombuffer(f.read(8 * blocks), "<u8")
        base = HEADER.size + 16 * docs + 8 * blocks
        ends = np.cumsum(counts)
        a = 0
        while a < docs:
            before = int(ends[a] - counts[a])
            b = max(a + 1, int(np.searchsorted(ends, before + (1 << 20), side="right")))
            after = int(ends[b - 1])
            k0, k1 = before // BLOCK, -(-after // BLOCK)
            w0, w1 = (int(firsts[k0]) if k0 < blocks else words), (int(firsts[k1]) if k1 < blocks else words)
            f.seek(base + 8 * w0)
            part = np.frombuffer(f.read(8 * (w1 - w0)), "<u8")
            ids = unpack(part, firsts[k0:k1] - np.uint64(w0), min(int(ends[-1]), k1 * BLOCK) - k0 * BLOCK)
            yield doc_ids[a:b], counts[a:b], ids[before - k0 * BLOCK : after - k0 * BLOCK]
            a = b


#: Stands for a null key in a file, and the ids of a shard.
NO_KEY, SHARD = -(1 << 63), 1 << 25


class _Chunks(dict):
    """The ids of each chunk of text, as bytes. A chunk is a space and what follows it up to the next space."""

    LIMIT = 1_000_000

    def __init__(self, encoder: Encoder, lead: str) -> None:
        super().__init__()
        self.encoder, self.lead = encoder, lead

    def __missing__(self, chunk: str) -> bytes:
        out = self.encoder.chunk(self.lead + chunk, chunk)
        if len(self) < self.LIMIT:  # chunks that come late are rare ones
            self[chunk] = out
        return out


class Encoder:
    """A byte-level BPE of the tokenizers library, with a bounded memory of chunks.

    The library splits a text into pieces before it merges; a space that a visible character follows always starts a
    piece, so chunks that start there encode independently. A text in which a space is followed by white space goes to
    the library as a whole.
    """

    TAIL = ",.;:!?%$#*&|"

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.known = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and spec.get("normalizer") is None and spec.get("post_processor") is None and pre.get("use_regex", True)
        self.model = self.tokenizer.model
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.dtype = np.dtype(np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        # Visible bytes stand for themselves in the vocabulary, the others for the code points from 256 on.
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(visible)]
        self.letters = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.tails: dict[str, bytes] = {}
        self.first, self.later = _Chunks(self, ""), _Chunks(self, " ")
        self.line_feed = self._bytes(self.piece("\n")) if self.known else b""

    def _bytes(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def whole(self, text: str) -> bytes:
        return self._bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def piece(self, text: str) -> list[int]:
        """The ids of what is known to be one piece."""
        return [t.id for t in self.model.tokenize(text.encode().decode("latin-1").translate(self.letters))]

    def chunk(self, text: str, bare: str) -> bytes:
        core = bare.rstrip(self.TAIL)
        if core.isalpha():
            lead, tail = text[: len(text) - len(bare)], bare[len(core) :]
            if tail and core in self.later and lead:  # the word alone is known
                return self.later[core] + self._tail(tail)
            return self._bytes(self.piece(lead + core)) + self._tail(tail)
        if "\n" in bare[1:-1]:  # a line feed between visible characters is a piece, and what follows it starts afresh
            lines = bare.split("\n")
            if all(x and not x[0].isspace() and not x[-1].isspace() for x in lines):
                return (self.later if len(text) > len(bare) else self.first)[lines[0]] + b"".join(self.line_feed + self.first[x] for x in lines[1:])
        return self.whole(text)

    def _tail(self, tail: str) -> bytes:
        if tail not in self.tails and len(self.tails) < 10_000:
            self.tails[tail] = self._bytes(self.piece(tail)) if tail else b""
        return self.tails[tail] if tail in self.tails else self._bytes(self.piece(tail))

    def encode(self, text: str) -> np.ndarray:
        if not self.known:
            return np.frombuffer(self.whole(text), self.dtype)
        first, *rest = text.split(" ")
        if not all(rest) or any(map(str.isspace, {c[0] for c in rest})) or not first and rest:
            return np.frombuffer(self.whole(text), self.dtype)
        return np.frombuffer((self.first[first] if first else b"") + b"".join(map(self.later.__getitem__, rest)), self.dtype)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file; a Python worker makes it once."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write_ids(df: DataFrame, path: str, vocabulary: str, end_id: int | None = 2, key: str = "doc_id", text: str = "text", partitions: int | None = None) -> DataFrame:
    """Encode every text, write shards below `path` in ascending order of `key`, and return their list.

    A null text is empty and has the end id only. A null key sorts first and comes back as null. Rows that repeat a key all
    stay, in order of their texts. Columns other than the two are not read. An empty table writes no shard. A task closes
    a shard at SHARD ids, so that it holds no more than that. The list has file, part, nth (of the part's shards),
    first_key, n_docs, n_ids; it is checkpointed, so a task that runs again after an executor was lost writes other files
    and never changes one in the list.
    """
    n = partitions or max(2 * df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = F.col("k").asc_nulls_first()
    rows = df.select(F.col(key).cast("long").alias("k"), text_of(text).alias("t")).repartitionByRange(n, order).sortWithinPartitions(order, "t")
    base = path.rstrip("/")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, number, nth = encoder(vocabulary), TaskContext.get().partitionId(), 0
        end = np.zeros(0, own.dtype) if end_id is None else np.array([end_id], own.dtype)
        filesystem, folder = fs.FileSystem.from_uri(base)
        keys, counts, packed, held, carry = [], [], [], 0, np.zeros(0, own.dtype)

        def close() -> pa.RecordBatch:
            filesystem.create_dir(folder)
            name = f"{number:06d}-{nth:04d}-{uuid.uuid4().hex}.s8b"
            doc_ids, sizes = np.concatenate(keys), np.concatenate(counts)
            total = write_shard(filesystem, f"{folder}/{name}", doc_ids, sizes, [*packed, (*pack(carry), len(carry))])
            return pa.RecordBatch.from_pydict({"file": [f"{base}/{name}"], "part": pa.array([number], pa.int32()), "nth": pa.array([nth], pa.int32()), "first_key": pa.array([doc_ids[0]], pa.int64()), "n_docs": pa.array([len(doc_ids)], pa.int64()), "n_ids": pa.array([total], pa.int64())})

        for batch in batches:
            for part in in_chunks(batch, "t"):
                found = []
                for t in part.column("t").to_pylist():
                    found += [own.encode(t), end]
                counts.append(np.fromiter((len(a) + len(b) for a, b in zip(found[::2], found[1::2], strict=True)), np.int64))
                keys.append(part.column("k").fill_null(NO_KEY).to_numpy(zero_copy_only=False))
                ids = np.concatenate([carry, *found])
                even = len(ids) // BLOCK * BLOCK
                packed.append((*pack(ids[:even]), even))
                carry, held = ids[even:], held + even
                if held >= SHARD:
                    yield close()
                    keys, counts, packed, held, carry, nth = [], [], [], 0, carry[:0], nth + 1
        if keys:
            yield close()

    return cut(rows.mapInArrow(write, "file string, part int, nth int, first_key long, n_docs long, n_ids long"))


def read_ids(shards: DataFrame, with_ids: bool = False) -> DataFrame:
    """The documents of the shards: doc_id, start (ids before it), n_tokens, ids_crc32; with_ids: and ids (array<long>).

    The list of shards is short (a row a file), so the running totals are made on the driver.
    """
    spark = shards.sparkSession
    listed = sorted((r.part, r.nth, r.file, r.n_ids) for r in shards.collect())
    starts = np.concatenate([[0], np.cumsum([n for *_, n in listed])]).astype(np.int64)
    files = spark.createDataFrame([(f, int(s)) for (_, _, f, _), s in zip(listed, starts, strict=False)], "file string, start long").repartition(max(1, len(listed)), "file")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, at in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                filesystem, path = fs.FileSystem.from_uri(file)
                for doc_ids, counts, ids in read_shard(filesystem, path):
                    ends = np.cumsum(counts)
                    data = memoryview(ids.astype("<u4").tobytes())
                    crcs = [zlib.crc32(data[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
                    out = {"doc_id": pa.array(doc_ids, mask=doc_ids == NO_KEY), "start": pa.array(at + ends - counts), "n_tokens": pa.array(counts), "ids_crc32": pa.array(crcs, pa.int64())}
                    if with_ids:
                        out["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int64)))
                    at += int(ends[-1])
                    yield pa.RecordBatch.from_pydict(out)

    return files.mapInArrow(read, schema)


def encode_documents(df: DataFrame, vocabulary: str, end_id: int | None = 2) -> DataFrame:
    """Write the ids of df's texts to a fresh place in the shared folder and read them back."""
    return read_ids(write_ids(df, scratch(df.sparkSession, "ids"), vocabulary, end_id))
