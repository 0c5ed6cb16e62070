"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Every word of every example is a term. A term weighs its inverse document frequency, counted over the whole corpus, times
its relevance: a floor plus the square of the standardised log-odds by which it leans to label 1 among the examples, so
that words which tell nothing hardly turn a vector. The index is inverted: each term has its postings, cut at the borders
of blocks of examples, with the largest weight in each block. Bounds of blocks are summed from those maxima first; only
blocks whose bound reaches the k-th best similarity have their postings read, so the search stays exact. Terms that many
examples have bound nothing: their postings are whole rows, multiplied at once for a batch of texts, and the block maxima
of that product are part of the bounds. Votes weighted by similarity give a raw score, and a logistic curve fitted on the
examples' own leave-one-out scores calibrates it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import give_back, in_chunks, text_of
from tessera.llm.quality import training_rows

THRESHOLD = 0.3
#: Labelled examples the index is fitted on, nearest examples, examples a block, texts searched at once.
SAMPLE, K, BLOCK, BATCH = 4000, 15, 64, 128
#: A term that one in so many examples has is held as a row of all examples.
COMMON = 16
#: The relevance of a term that tells nothing, and the weight with which the prior votes.
FLOOR, PULL = 0.02, 0.05


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def text_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(codes, offsets, words of each code, words): the white-space tokens of texts as codes, and the lower-case words in each code."""
    tokens = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(texts.cast(pa.large_string())))
    coded = tokens.flatten().dictionary_encode()
    clean = pc.replace_substring_regex(pc.utf8_lower(coded.dictionary), r"[^\p{L}\p{N}]+", " ")
    words = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(clean))
    return coded.indices.to_numpy(zero_copy_only=False), tokens.offsets.to_numpy().astype(np.int64), words.offsets.to_numpy().astype(np.int64), words.flatten()


def vocabulary_of(texts: pa.Array) -> pa.Array:
    """The distinct words of texts, ascending."""
    words = pc.unique(text_words(texts)[3])
    words = words.filter(pc.not_equal(words, ""))
    return words.take(pc.sort_indices(words))


def count_terms(texts: pa.Array, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, count) of the terms in the texts, ascending."""
    codes, offsets, borders, words = text_words(texts)
    if not len(codes) or not len(terms):
        return (np.zeros(0, np.int64),) * 3
    number = pc.index_in(words, value_set=terms).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    size = np.diff(borders)[codes]
    term = number[ranges(borders[:-1][codes], size)]
    text = np.repeat(np.repeat(np.arange(len(texts)), np.diff(offsets)), size)
    pair, count = np.unique((text * len(terms) + term)[term >= 0], return_counts=True)
    return pair // len(terms), pair % len(terms), count


@dataclass
class Index:
    terms: pa.Array
    weight: np.ndarray  # of each term
    ids: np.ndarray  # of the examples, block by block
    y: np.ndarray
    common: np.ndarray  # the row of each term that many examples have, -1 for others
    rows: np.ndarray  # common terms x examples
    runs: np.ndarray  # where each other term's runs begin, and the end; a run is a term's postings in one block
    block: np.ndarray  # of each run
    top: np.ndarray  # the largest weight of each run
    posts: np.ndarray  # where each run's postings begin, and the end
    example: np.ndarray  # of each posting
    value: np.ndarray
    prior: float  # the share of label 1 among examples without any term
    curve: tuple[float, float]

    def units(self, text: np.ndarray, term: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
        """The TF-IDF weights of the terms of n texts, each text a unit vector."""
        w = np.log1p(count) * self.weight[term]
        return w / np.sqrt(np.bincount(text, w * w, n))[text]

    def search(self, text: np.ndarray, term: np.ndarray, q: np.ndarray, n: int, k: int = K, without: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each of n texts the k nearest (examples, similarities), and those that tie with the last; only similarities above 0. Ties by id.

        (text, term, q) are the unit vectors, ascending by text; without: an example that each text leaves out.
        """
        if not len(self.ids):
            yield from ((np.zeros(0, np.int64), np.zeros(0)) for _ in range(n))
            return
        cuts = np.searchsorted(text, np.arange(n + 1))
        for a in range(0, n, BATCH):
            b = min(a + BATCH, n)
            part = slice(cuts[a], cuts[b])
            row = self.common[term[part]]
            many = row >= 0
            shared = np.zeros((b - a, len(self.rows)))
            shared[text[part][many] - a, row[many]] = q[part][many]
            sims = shared @ self.rows
            bounds = np.maximum.reduceat(sims, np.arange(0, len(self.ids), BLOCK), axis=1)
            for i in range(a, b):
                own = slice(cuts[i], cuts[i + 1])
                yield self._nearest(term[own], q[own], sims[i - a], bounds[i - a], k, None if without is None else int(without[i]))

    def _nearest(self, term: np.ndarray, q: np.ndarray, sim: np.ndarray, bound: np.ndarray, k: int, without: int | None) -> tuple[np.ndarray, np.ndarray]:
        """The search of one text, from its similarities by common terms and their block maxima on."""
        size = self.runs[term + 1] - self.runs[term]
        run, by = ranges(self.runs[term], size), np.repeat(q, size)
        at = self.block[run]
        bound = bound + np.bincount(at, by * self.top[run], len(bound))
        ahead = np.argsort(-bound, kind="stable")[: 1 + -(-k // BLOCK)]
        chosen = np.zeros(len(bound), bool)
        chosen[ahead] = True
        last = 0.0
        for _ in range(2):  # the blocks of the largest bounds, then all others that may hold one of the k nearest
            mine = chosen[at]
            first = self.posts[run[mine]]
            number = self.posts[run[mine] + 1] - first
            post = ranges(first, number)
            sim = sim + np.bincount(self.example[post], np.repeat(by[mine], number) * self.value[post], len(sim))
            if without is not None:
                sim[without] = 0
            last = float(np.partition(sim, -k)[-k]) if len(sim) >= k else 0.0
            chosen = (bound >= last - 1e-8) & (bound > 0)
            chosen[ahead] = False
        found = np.round(sim, 9)
        who = np.flatnonzero((found >= round(last, 9)) & (found > 0))
        who = who[np.lexsort((self.ids[who], -found[who]))]
        return who, found[who]

    def raw(self, who: np.ndarray, sim: np.ndarray) -> float:
        """The weighted vote of the nearest examples, with a small vote for the prior."""
        weight = sim**2
        return float((weight @ self.y[who] + PULL * self.prior) / (weight.sum() + PULL))

    def score(self, who: np.ndarray, sim: np.ndarray) -> float:
        a, b = self.curve
        return float(1 / (1 + np.exp(-(a * self.raw(who, sim) + b)))) if len(who) else self.prior


def relevance(text: np.ndarray, term: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Of each term: the floor, plus the square of its standardised log-odds if it is likelier in examples of label 1."""
    ones = np.bincount(term[y[text] == 1], minlength=n) + 0.5
    zeros = np.bincount(term[y[text] == 0], minlength=n) + 0.5
    odds = np.log((ones / (y.sum() + 1)) / (zeros / ((1 - y).sum() + 1)))
    return FLOOR + np.maximum(odds / np.sqrt(1 / ones + 1 / zeros), 0) ** 2


def curve_of(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and constant of a logistic curve; a light pull to (4, -2) keeps it finite and rising where the votes separate the labels."""
    a, b = 4.0, -2.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        g = np.array([((p - y) * x).sum() + 0.5 * (a - 4), (p - y).sum() + 0.5 * (b + 2)])
        h = np.array([[(w * x * x).sum() + 0.5, (w * x).sum()], [(w * x).sum(), w.sum() + 0.5]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(max(a, 0.1)), float(b)


def build(ids: np.ndarray, texts: list[str], y: np.ndarray, frequencies: Callable[[pa.Array], tuple[np.ndarray, int]]) -> Index:
    """The index over labelled examples; frequencies(terms) gives their document frequencies and the number of documents."""
    y = np.asarray(y, float)
    values = pa.array(texts, pa.large_string())
    # Without labels of both kinds there is nothing to learn.
    terms = vocabulary_of(values) if len(texts) and 0 < y.sum() < len(y) else pa.array([], pa.large_string())
    df, n = frequencies(terms) if len(terms) else (np.zeros(0), 0)
    text, term, count = count_terms(values, terms)
    weight = (np.log((1 + n) / (1 + df)) + 1) * relevance(text, term, y, len(terms)) if len(terms) else np.zeros(0)
    w = np.log1p(count) * weight[term]
    size = np.bincount(text, minlength=len(texts))
    norm = np.sqrt(np.bincount(text, w * w, len(texts)))
    w = w / norm[text]
    empty = size == 0
    prior = float((y[empty].sum() + y.mean()) / (empty.sum() + 1)) if len(y) else 0.5
    # Blocks of examples with the same heavy terms have tight bounds.
    heavy = np.zeros(len(texts), np.int64)
    by_weight = np.lexsort((term, w, text))
    heavy[text[by_weight]] = term[by_weight]  # the last one of a text, its heaviest, stays
    order = np.lexsort((ids, heavy))
    order = order[~empty[order]]
    place = np.full(len(texts), -1)
    place[order] = np.arange(len(order))
    example = place[text]
    common = np.full(len(terms), -1)
    often = np.flatnonzero(np.bincount(term, minlength=len(terms)) * COMMON >= max(len(order), 1))
    common[often] = np.arange(len(often))
    rows = np.zeros((len(often), len(order)))
    many = common[term] >= 0
    rows[common[term[many]], example[many]] = w[many]
    sort = np.lexsort((example, term))
    sort = sort[~many[sort]]
    own, at, value = term[sort], example[sort], w[sort]
    first = np.ones(len(own), bool)
    first[1:] = (own[1:] != own[:-1]) | (at[1:] // BLOCK != at[:-1] // BLOCK)
    begin = np.flatnonzero(first)
    top = np.maximum.reduceat(value, begin) if len(begin) else np.zeros(0)
    runs = np.searchsorted(own[begin], np.arange(len(terms) + 1))
    index = Index(terms, weight, ids[order], y[order], common, rows, runs, at[begin] // BLOCK, top, np.append(begin, len(own)), at, value, prior, (4.0, -2.0))
    if len(order):
        by = np.lexsort((term, example))
        votes = [index.raw(*found) for found in index.search(example[by], term[by], w[by], len(order), without=np.arange(len(order)))]
        index.curve = curve_of(np.array(votes), index.y)
    return index


def document_frequencies(docs: DataFrame, terms: pa.Array) -> tuple[np.ndarray, int]:
    """In how many of all documents each term occurs, and the number of documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(terms), np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for part in in_chunks(batch, "t"):
                total += np.bincount(count_terms(part.column("t"), terms)[1], minlength=len(terms))
        has = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": pa.array(np.append(has, -1), pa.int32()), "n": pa.array(np.append(total[has], n), pa.int64())})

    found = docs.select(text_of("text").alias("t")).mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = found.column("term").to_numpy(), found.column("n").to_numpy()
    df = np.zeros(len(terms))
    df[term[term >= 0]] = n[term >= 0]
    return df, int(n[term < 0].sum())


def train(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> Index:
    """An index over at most `limit` labelled documents outside the held-out fold; term statistics cover all documents.

    The driver holds those documents and their postings, and every task a copy of the index: some 50 MB for 4000 documents here.
    """
    rows = training_rows(docs, labels, "toxic", 4, 2, limit).collect()
    rows.sort(key=lambda r: (r.doc_id, r.y, r.text))
    index = build(np.array([r.doc_id for r in rows], np.int64), [r.text for r in rows], np.array([r.y for r in rows], np.int64), lambda terms: document_frequencies(docs, terms))
    del rows
    give_back()
    return index


def score_toxicity(df: DataFrame, index: Index, text: str = "text", out: str = "score", evidence: str = "evidence") -> DataFrame:
    """df with the probability of label 1 and, as evidence, the ids of the K nearest labelled examples, nearest first.

    Only the whole text counts: examples that tie with the K-th nearest all vote, so that no id decides. A null text is
    empty; a text without any word of an example has no neighbour and gets the share of label 1 among such examples. Equal
    texts score alike. Columns named as the outputs are replaced, others stay.
    """
    rest = [c for c in df.columns if c not in (out, evidence)]
    rows = df.select(*[F.col(f"`{c}`") for c in rest], text_of(text).alias("__t"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*[f"`{c}`" for c in rest]).schema.fields) + f", `{out}` double, `{evidence}` array<long>"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_chunks(batch, "__t"):
                row, term, count = count_terms(part.column("__t"), index.terms)
                near = index.search(row, term, index.units(row, term, count, part.num_rows), part.num_rows)
                found = [(round(index.score(who, sim), 6), index.ids[who[:K]].tolist()) for who, sim in near]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in rest], pa.array([p for p, _ in found], pa.float64()), pa.array([w for _, w in found], pa.list_(pa.int64()))], names=[*rest, out, evidence])

    return rows.mapInArrow(score, schema)
