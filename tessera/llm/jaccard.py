"""N-gram Jaccard join with Bayesian pruning of candidates.

Texts with equal shingle sets are one node. Bands of MinHash values gather the nodes that may be similar into clusters;
within a cluster every pair is compared on more and more MinHash values and dropped as soon as the posterior probability
that its similarity reaches the threshold falls below a tolerance; what is left is verified on the sets themselves. A
cluster too large for one task is cut into blocks, and tasks take pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, in_chunks, mix64, shingle_sets, text_of
from tessera.llm.components import components

WIDTH, THRESHOLD = 5, 0.8
HASHES, BANDS, STEP = 128, 32, 16
#: A pair is dropped when its similarity reaches the threshold with less than this probability.
TOLERANCE = 1e-6
#: Nodes and shingles of a block; a task holds two.
BLOCK_NODES, BLOCK_SHINGLES = 1024, 1_000_000


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    seeds = mix64(np.arange(1, 2 * HASHES + 1).astype(np.uint64))
    return (seeds[:HASHES] | np.uint64(1)).astype(np.uint32), seeds[HASHES:].astype(np.uint32)


def minhash(shingles: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """HASHES MinHash values (uint32) of each set; a set without members has the largest value throughout."""
    a, b = _multipliers()
    out = np.full((len(offsets) - 1, HASHES), 0xFFFFFFFF, np.uint32)
    low = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    for i, (s, e) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        for k in range(s, e, 4096):  # a slice at a time, for long texts
            x = low[k : min(e, k + 4096), None] * a + b
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x2C1B3C6D)
            np.minimum(out[i], x.min(axis=0), out=out[i])
    return out


def least_matches(threshold: float, tolerance: float) -> dict[int, int]:
    """After n compared values, the matches below which a pair is dropped, under a uniform prior of the similarity.

    The posterior after m matches is Beta(m + 1, n - m + 1); it exceeds the threshold with the probability that a
    binomial of n + 1 trials has at most m successes.
    """
    table = {}
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, 0
        while m <= n:
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                break
            m += 1
        table[n] = m
    return table


def links_of(shingles: np.ndarray, offsets: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of `left` that has any: the rows of `right`, beyond itself, whose sets are similar. Rows are places in `offsets`; where a row is on both sides a pair comes once."""
    sizes = np.diff(offsets)
    sig = minhash(shingles, offsets)
    need = least_matches(threshold, tolerance)
    _, codes = np.unique(shingles, return_inverse=True)
    flag = np.zeros(int(codes.max()) + 1 if len(codes) else 1, bool)
    both = np.isin(right, left)
    for i in left.tolist():
        js = right[(right > i) | ~both]
        small, large = np.minimum(sizes[js], sizes[i]), np.maximum(sizes[js], sizes[i])
        js = js[(js != i) & (small >= threshold * large - 1e-9) & (small > 0)]
        matches = np.zeros(len(js), np.int64)
        for n in range(STEP, HASHES + 1, STEP):
            if not len(js):
                break
            matches += (sig[js, n - STEP : n] == sig[i, n - STEP : n]).sum(axis=1)
            keep = matches >= need[n]
            js, matches = js[keep], matches[keep]
        if not len(js):
            continue
        flag[codes[offsets[i] : offsets[i + 1]]] = True
        n = sizes[js]
        before = np.cumsum(n) - n
        member = flag[codes[np.arange(int(n.sum())) + np.repeat(offsets[js] - before, n)]]
        common = np.add.reduceat(member.astype(np.int64), before)
        flag[codes[offsets[i] : offsets[i + 1]]] = False
        js = js[common >= threshold * (sizes[i] + n - common) - 1e-9]
        if len(js):
            yield i, js


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in in_chunks(batch, "t"):
            shingles, offsets = shingle_sets(part.column("t"), WIDTH)
            raw = memoryview(shingles.tobytes())
            o = offsets.tolist()
            sets = [xxhash.xxh3_128_digest(raw[8 * a : 8 * b]) for a, b in zip(o, o[1:], strict=False)]
            bands = minhash(shingles, offsets).reshape(-1, BANDS, HASHES // BANDS).astype(np.uint64)
            key = np.full(bands.shape[:2], 0, np.uint64) + np.arange(BANDS, dtype=np.uint64)
            with np.errstate(over="ignore"):
                for k in range(HASHES // BANDS):
                    key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, k])
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, key.size + 1, BANDS, dtype=np.int32)), pa.array(key.view(np.int64).ravel()))
            yield pa.RecordBatch.from_pydict({"id": part.column("id"), "sub": part.column("sub"), "n": pa.array(np.diff(offsets)), "same": pa.array(sets, pa.binary()), "bands": flat})


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (cluster, i, j): links of each group. A row has its block; i <= j are the blocks that its group compares."""

    def group(rows: list[tuple[int, int, str]], i: int, j: int) -> pa.RecordBatch:
        ids = np.array([r[0] for r in rows])
        block = np.array([r[1] for r in rows])
        order = np.lexsort((ids, block))
        ids, block = ids[order], block[order]
        shingles, offsets = shingle_sets(pa.array([rows[k][2] for k in order.tolist()], pa.large_string()), WIDTH)
        places = np.arange(len(ids))
        label, count = places.copy(), np.zeros(len(ids), np.int64)
        for a, js in links_of(shingles, offsets, places[block == i], places[block == j]):
            count[a] += len(js)
            np.add.at(count, js, 1)
            met = np.unique(np.r_[label[a], label[js]])
            if len(met) > 1:
                label[np.isin(label, met)] = met[0]
        some = count > 0
        return pa.RecordBatch.from_pydict({"id": pa.array(ids[some]), "to": pa.array(ids[label[some]]), "links": pa.array(count[some])})

    key, rows = None, []
    for batch in batches:
        for c, i, j, b, d, t in zip(*(batch.column(n).to_pylist() for n in ("cluster", "i", "j", "block", "id", "t")), strict=True):
            if (c, i, j) != key:
                if len(rows) > 1:
                    yield group(rows, key[1], key[2])
                key, rows = (c, i, j), []
            rows.append((d, b, t))
    if len(rows) > 1:
        yield group(rows, key[1], key[2])


def jaccard_classes(df: DataFrame, key: str = "doc_id", text: str = "text", first: bool = False) -> DataFrame:
    """Per row: key, class_id (the least key of its class), n_links (other distinct shingle sets linked to its own), n_copies (rows with its shingle set).

    Two texts are linked when the Jaccard similarity of their sets of five-word shingles is 0.8 or more; classes are the
    connected components. Words are lower-case runs without white space; a text of one to four words has one shingle, all
    its words. A null or empty text has no shingles: it is a class of its own, without links. A row with a null key is
    compared with nothing and has a null class. A key may have several texts: each row counts with its own. Other columns
    are not read. first: also sub (the hash of the text) and is_first (whether key and text are the least of the class).
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("long").alias("id"), text_of(text).alias("t")).select("id", F.xxhash64("t").alias("sub"), "t")
    sketch = cut(rows.mapInArrow(_sketch, "id long, sub long, n long, same binary, bands array<long>"))
    has = sketch.where("n > 0 and id is not null")
    # Each distinct set is a node, with a number of its own; the least key with that set stands for it.
    sets = cut(has.groupBy("same").agg(F.min("id").alias("rep"), F.count("*").alias("n_copies")).withColumn("node", F.monotonically_increasing_id()))
    nodes = has.join(sets.select(F.col("rep").alias("id"), "same", "node"), ["id", "same"]).dropDuplicates(["node"])
    bands = nodes.select("node", F.explode("bands").alias("band"))
    leads = bands.groupBy("band").agg(F.min("node").alias("lead"), F.count("*").alias("m")).where("m > 1").drop("m")
    stars = bands.join(leads, "band").where("node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b"))
    cluster = cut(components(stars).join(nodes.select("node", "n", "id", "sub"), "node"))
    size = cluster.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / BLOCK_NODES), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    placed = cluster.join(size, "root").select("node", "id", "sub", F.col("root").alias("cluster"), "blocks", block.alias("block"))
    texts = rows.join(placed, ["id", "sub"]).dropDuplicates(["node"])
    dealt = texts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", F.col("node").alias("id"), "t")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    groups = dealt.repartition(n, "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "id")
    found = cut(groups.mapInArrow(_compare, "id long, to long, links long"))
    roots = components(found.select(F.col("id").alias("a"), F.col("to").alias("b")))
    links = found.groupBy("id").agg(F.sum("links").alias("n_links"))
    joined = sets.join(roots, "node", "left").join(links.withColumnRenamed("id", "node"), "node", "left").select("same", "rep", F.coalesce("root", "node").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies")
    least = joined.groupBy("root").agg(F.min("rep").alias("class_id"))
    of_set = joined.join(least, "root")
    matched = has.join(of_set, "same").select(F.col("id").alias(key), "class_id", "n_links", "n_copies", "sub", "root")
    alone = sketch.where("n = 0 or id is null").select(F.col("id").alias(key), F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"), "sub")
    if not first:
        return matched.drop("sub", "root").unionByName(alone.drop("sub"))
    lowest = matched.where(F.col(key) == F.col("class_id")).groupBy("root").agg(F.min("sub").alias("low"))
    marked = matched.join(lowest, "root").withColumn("is_first", (F.col(key) == F.col("class_id")) & (F.col("sub") == F.col("low")))
    return marked.drop("root", "low").unionByName(alone.withColumn("is_first", F.lit(True)))
