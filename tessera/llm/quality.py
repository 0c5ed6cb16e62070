"""Document quality by a byte-level convolutional network in numpy.

A text is its UTF-8 bytes. Every byte has a learned vector; learned filters of WIDTH bytes step over the whole text STRIDE
bytes at a time; runs of CHUNK steps, one every HOP steps, so that a quarter of each is in the next, are max-pooled; the mean
and the maximum of the chunks' features are combined into one probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import give_back, in_chunks, text_of

STRIDE, WIDTH, DIM, FILTERS, CHUNK, HOP = 4, 8, 8, 24, 256, 192
THRESHOLD = 0.3


@dataclass
class Model:
    embed: np.ndarray  # 256 x DIM
    filters: np.ndarray  # WIDTH * DIM x FILTERS
    bias: np.ndarray  # FILTERS
    head: np.ndarray  # weights of mean and maximum, then the constant


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def lay_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, steps of each text): texts one after the other, each padded with zeros to whole steps and one step more, so no filter sees two texts."""
    steps = np.array([max(1, -(-len(t) // STRIDE)) for t in texts], np.int64)
    data = b"".join(t + bytes(int(s + 1) * STRIDE - len(t)) for t, s in zip(texts, steps, strict=True))
    return np.frombuffer(data, np.uint8), steps


def pooled(m: Model, texts: list[bytes]) -> np.ndarray:
    """A row of 2 * FILTERS features for each text: the mean and the maximum over its chunks."""
    data, steps = lay_out(texts)
    cells = m.embed[data].reshape(-1, STRIDE * DIM)
    h = cells @ m.filters[: STRIDE * DIM]
    h[:-1] += cells[1:] @ m.filters[STRIDE * DIM :]
    start = np.concatenate([[0], np.cumsum(steps + 1)])[:-1]
    chunks = 1 + -(-np.maximum(steps - CHUNK, 0) // HOP)
    row = np.repeat(np.arange(len(texts)), chunks)
    first = np.concatenate([[0], np.cumsum(chunks)])[:-1]
    begin = start[row] + (np.arange(len(row)) - first[row]) * HOP
    end = np.minimum(begin + CHUNK, start[row] + steps[row])
    bounds = np.stack([begin, end], 1).ravel()
    top = np.maximum.reduceat(h, bounds, axis=0)[::2]  # the other half are no chunks
    top = np.maximum(top + m.bias, 0)
    mean = np.add.reduceat(top, first, axis=0) / chunks[:, None]
    return np.concatenate([mean, np.maximum.reduceat(top, first, axis=0)], axis=1)


def fit(texts: list[bytes], labels: np.ndarray, seed: int = 7, steps: int = 500, batch: int = 64) -> Model:
    """Learn from whole texts: the filters from random crops, then the combination from all chunks. Deterministic.

    Without labels of both kinds there is nothing to learn: the score is then the share of label 1, or 0.5 without any.
    """
    r = np.random.default_rng(seed)
    embed = r.normal(0, 0.5, (256, DIM)).astype(np.float32)
    filters = r.normal(0, (WIDTH * DIM) ** -0.5, (WIDTH * DIM, FILTERS)).astype(np.float32)
    bias = np.zeros(FILTERS, np.float32)
    y = np.asarray(labels, np.float32)
    model = Model(embed, filters, bias, np.zeros(2 * FILTERS + 1, np.float32))
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        model.head[-1] = np.log(max(share, 1e-3) / max(1 - share, 1e-3))
        return model
    out, shift = r.normal(0, 0.2, FILTERS).astype(np.float32), np.zeros(1, np.float32)
    params = [embed, filters, bias, out, shift]
    moment = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    span = CHUNK * STRIDE
    kinds = [np.flatnonzero(y == 0), np.flatnonzero(y == 1)]
    for t in range(1, steps + 1):
        rows = np.concatenate([r.choice(k, batch // 2) for k in kinds])
        data = np.zeros((batch, span + STRIDE), np.uint8)
        for i, j in enumerate(rows):
            text = texts[j]
            a = int(r.integers(0, max(1, len(text) - span + 1)))
            crop = np.frombuffer(text[a : a + span], np.uint8)
            data[i, : len(crop)] = crop
        cells = embed[data].reshape(batch, CHUNK + 1, STRIDE * DIM)
        window = np.concatenate([cells[:, :-1], cells[:, 1:]], axis=2)
        h = window.reshape(-1, WIDTH * DIM) @ filters
        h = h.reshape(batch, CHUNK, FILTERS)
        where = h.argmax(1)
        top = np.take_along_axis(h, where[:, None, :], 1)[:, 0] + bias
        act = np.maximum(top, 0)
        miss = (_sigmoid(act @ out + shift) - y[rows]) / batch
        g_act = np.outer(miss, out) * (top > 0)
        seen = window[np.arange(batch)[:, None], where]  # batch x FILTERS x WIDTH * DIM
        g_filters = np.einsum("bf,bfk->kf", g_act, seen)
        g_window = (g_act[:, :, None] * filters.T[None]).reshape(batch * FILTERS, WIDTH, DIM)
        bytes_at = data[np.arange(batch)[:, None, None], (where * STRIDE)[:, :, None] + np.arange(WIDTH)].reshape(-1)
        g_embed = np.zeros_like(embed)
        np.add.at(g_embed, bytes_at, g_window.reshape(-1, DIM))
        grads = [g_embed, g_filters + 1e-4 * filters, g_act.sum(0), act.T @ miss, miss.sum(keepdims=True)]
        for p, g, (m1, m2) in zip(params, grads, moment, strict=True):
            m1 += 0.1 * (g - m1)
            m2 += 0.001 * (g * g - m2)
            p -= (0.01 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    parts = np.cumsum([len(t) for t in texts]) >> 18  # a text of more than 256 kilobytes is a part of its own
    edges = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(texts)]
    x = np.concatenate([pooled(model, texts[a:b]) for a, b in zip(edges, edges[1:], strict=False)]).astype(np.float64)
    scale = x.std(0) + 1e-6
    centre = x.mean(0)
    z = np.concatenate([(x - centre) / scale, np.ones((len(x), 1))], axis=1)
    w = np.zeros(z.shape[1])
    ridge = np.r_[np.full(z.shape[1] - 1, 1.0), 1e-6]
    for _ in range(25):  # Newton steps of a ridge logistic regression
        p = _sigmoid(z @ w)
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    model.head = np.r_[w[:-1] / scale, w[-1] - (w[:-1] / scale) @ centre].astype(np.float32)
    return model


def training_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, limit: int) -> DataFrame:
    """At most `limit` labelled documents outside the held-out fold, by a hash of their id: doc_id, text, y."""
    fold = F.crc32(F.col("doc_id").cast("string")) % folds
    chosen = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold != held_out)).select("doc_id", F.col(label).cast("int").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(limit)
    return docs.select("doc_id", text_of("text").alias("text")).join(F.broadcast(chosen), "doc_id")  # `limit` rows bound the broadcast


#: Labelled documents that the model is fitted on, each by its whole text.
SAMPLE = 3000


def train(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> Model:
    rows = training_rows(docs, labels, "quality", 5, 0, limit).select("doc_id", "text", "y").collect()
    rows.sort(key=lambda r: (r.doc_id, r.y, r.text))
    model = fit([r.text.encode() for r in rows], np.array([r.y for r in rows]))
    del rows
    give_back()  # the driver goes on to other stages
    return model


def score_quality(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """df with column `out`: the probability of label 1, from the whole text alone.

    A null text counts as empty; an empty one is scored as padding. Equal texts have equal scores up to float rounding of
    six digits. A column named `out` is replaced, other columns stay. Texts are taken a few megabytes at a time.
    """
    rest = [c for c in df.columns if c != out]
    rows = df.select(*[F.col(f"`{c}`") for c in rest], text_of(text).alias("__t"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*[f"`{c}`" for c in rest]).schema.fields) + f", `{out}` double"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_chunks(batch, "__t", 1 << 20):
                x = pooled(model, part.column("__t").cast(pa.binary()).to_pylist())
                p = _sigmoid((x @ model.head[:-1] + model.head[-1]).astype(np.float64))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in rest], pa.array(np.round(p, 6))], names=[*rest, out])

    return rows.mapInArrow(score, schema)
