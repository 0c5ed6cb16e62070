"""Benchmark decontamination by SimHash over item-sized windows.

All of it is DataFrame operations. The word shingles that a document shares with an item propose every window of the item's
length that holds enough of their weight, in whatever order. The windows get weighted SimHash fingerprints; fingerprints of windows and of items of the
same length meet when one of RADIUS + 1 bit blocks is equal, which every pair within RADIUS bits has; pairs within it are
verified by the weighted Jaccard similarity of their shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, text_of

WIDTH, THRESHOLD = 5, 0.8
#: Two sets of similarity 0.8 differ in 10 of 64 bits on average; 20 is over three deviations more.
RADIUS = 20
#: Shingles of a benchmark up to which its side is broadcast (40 bytes each); a larger one is shuffled.
BROADCAST_ROWS = 200_000


def _words(text: str) -> Column:
    return F.filter(F.split(F.lower(text_of(text)), r"\s+"), lambda w: w != "")


def _shingles(hashes: str, width: int) -> Column:
    """The hash of each run of `width` words; none when there are fewer."""
    one = lambda i: F.xxhash64(F.lit(width), *[F.get(F.col(hashes), i + k) for k in range(width)])
    return F.when(F.size(hashes) >= width, F.transform(F.sequence(F.lit(0), F.size(hashes) - width), one)).otherwise(F.array().cast("array<long>"))


def _fingerprint(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, mass (summed weights) and print (64 bits) of rows (keys, shingle, weight) with distinct shingles."""
    bit = lambda b: F.sum(F.when(F.shiftright("shingle", b).bitwiseAND(F.lit(1)) == 1, F.col("weight")).otherwise(-F.col("weight"))).alias(f"b{b}")
    summed = rows.groupBy(*keys).agg(F.sum("weight").alias("mass"), *[bit(b) for b in range(64)])
    bits = [F.when(F.col(f"b{b}") > 0, F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")) for b in range(64)]
    out = bits[0]
    for x in bits[1:]:
        out = out.bitwiseOR(x)
    return summed.select(*keys, "mass", out.alias("print"))


def _blocks(radius: int) -> Column:
    """(block, value) of a fingerprint: radius + 1 runs of bits."""
    edges = [64 * i // (radius + 1) for i in range(radius + 2)]
    return F.array(*[F.struct(F.lit(i).alias("block"), F.shiftright("print", a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("value")) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))])


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, radius: int = RADIUS, hashed: bool = False) -> DataFrame:
    """A row for each document and item of which it has a passage: key, item key, start (of the best window, in words from 0), n_words, similarity.

    Words are lower-case runs without white space, shingles five of them (all words of an item that has fewer). The
    similarity of a window and an item is that of their shingle sets, a shingle weighing ln(1 + items / items that have it)
    in thousandths, ln(1 + items) where none has; from `threshold` on it is a leak, wherever the window starts. The best
    window is the most similar of those that a shared shingle lines up with an item, or of all where none of those is a
    leak, the first among equals; near the ends of a document, windows are moved inside; one that is longer than the document is
    all of it. Null or empty texts and rows with null keys have no leaks; a key may have several texts, each with its own rows; rows that repeat key and text count once;
    an empty table on either side gives no rows; other columns are not read. Documents of any length are scanned whole.
    hashed: also sub, the hash of the text.
    """
    items = benchmark.where(F.col(item_key).isNotNull()).select(F.col(item_key).alias("item"), _words(item_text).alias("w")).dropDuplicates(["item", "w"])
    items = items.where("size(w) > 0").select("item", F.size("w").alias("n_words"), F.transform("w", lambda w: F.xxhash64(w)).alias("h"))
    items = cut(items.withColumn("width", F.least("n_words", F.lit(WIDTH))))
    n_items = items.select("item").distinct().count()
    widths = sorted(r.width for r in items.select("width").distinct().collect())  # five at most
    if not widths:
        widths = [WIDTH]
    of_items = F.coalesce(*[F.when(F.col("width") == w, _shingles("h", w)) for w in widths])
    placed = cut(items.select("item", "n_words", "width", F.posexplode(of_items).alias("offset", "shingle")))
    weights = placed.groupBy("shingle").agg(F.round(1000 * F.log(1 + F.lit(n_items) / F.countDistinct("item"))).cast("long").alias("weight"))
    top = F.round(1000 * F.log(F.lit(1.0 + n_items))).cast("long")
    small = placed.count() <= BROADCAST_ROWS
    near = F.broadcast if small else (lambda df: df)
    weights = cut(weights)
    item_sets = placed.select("item", "n_words", "width", "shingle").distinct().join(near(weights), "shingle")
    prints = cut(_fingerprint(item_sets, ["item", "n_words", "width"]))

    named = F.struct(F.col(key).cast("long").alias("id"), F.xxhash64(text_of(text)).alias("sub")).alias("doc")
    rows = docs.where(F.col(key).isNotNull()).select(named, F.transform(_words(text), lambda w: F.xxhash64(w)).alias("h"))
    found = None
    for w in widths:
        each = rows.select("doc", F.size("h").alias("n"), F.posexplode(_shingles("h", w)).alias("pos", "shingle"))
        hit = each.join(near(placed.where(F.col("width") == w)), "shingle")
        found = hit if found is None else found.unionByName(hit)
    # A window can be similar only if the document has enough of the item's shingles at all.
    hits = cut(found.join(near(weights), "shingle").select("doc", "item", "n_words", "width", "n", "pos", "offset", "weight").distinct())
    enough = hits.select("doc", "item", "n_words", "width", "offset", "weight").distinct().groupBy("doc", "item", "n_words", "width").agg(F.sum("weight").alias("got")).join(near(prints.select("item", "n_words", "width", "mass")), ["item", "n_words", "width"])
    # Offsets of a repeated shingle each count, so `got` is no less than the weight of the shared set.
    enough = enough.where(F.col("got") >= F.lit(threshold) * F.col("mass") - 1e-9).select("doc", "item", "n_words", "width", "mass")
    # Every start has the places of shared shingles that its window holds; a shingle at two places counts twice, so again no window is lost.
    places = hits.select("doc", "item", "n_words", "width", "n", "pos", "weight").distinct().join(enough, ["doc", "item", "n_words", "width"])
    starts = F.sequence(F.greatest(F.lit(0), F.col("pos") + F.col("width") - F.col("n_words")), F.least(F.col("pos"), F.greatest(F.lit(0), F.col("n") - F.col("n_words"))))
    held = places.withColumn("start", F.explode(starts)).groupBy("doc", "item", "n_words", "width", "n", "mass", "start").agg(F.sum("weight").alias("got"))
    every = held.where(F.col("got") >= F.lit(threshold) * F.col("mass") - 1e-9).select("doc", "start", "n_words", "width", F.lit(False).alias("aligned"))
    aligned = hits.join(enough, ["doc", "item", "n_words", "width"], "left_semi").select("doc", F.greatest(F.lit(0), F.least(F.col("pos") - F.col("offset"), F.col("n") - F.col("n_words"))).alias("start"), "n_words", "width", F.lit(True).alias("aligned"))
    windows = cut(every.unionByName(aligned).groupBy("doc", "start", "n_words", "width").agg(F.max("aligned").alias("aligned")))
    by_doc = windows.groupBy("doc").agg(F.collect_set(F.struct("start", "n_words", "width")).alias("at"))
    texts = docs.where(F.col(key).isNotNull()).select(named, F.col(text).alias("__t")).join(by_doc, "doc")
    split = texts.select("doc", F.transform(_words("__t"), lambda w: F.xxhash64(w)).alias("h"), F.explode("at").alias("at")).select("doc", "at.*", F.col("h"))
    inside = split.select("doc", "start", "n_words", "width", F.slice("h", F.col("start") + 1, F.col("n_words")).alias("h"))
    sets = inside.select("doc", "start", "n_words", "width", F.explode(F.array_distinct(F.coalesce(*[F.when(F.col("width") == w, _shingles("h", w)) for w in widths]))).alias("shingle")).distinct()
    sets = cut(sets.join(near(weights), "shingle", "left").withColumn("weight", F.coalesce("weight", top)))
    window_prints = _fingerprint(sets, ["doc", "start", "n_words", "width"]).withColumnRenamed("mass", "window_mass")
    left = window_prints.withColumn("b", F.explode(_blocks(radius))).select("doc", "start", "n_words", "width", "window_mass", "print", "b.*")
    right = prints.withColumn("b", F.explode(_blocks(radius))).select("item", "n_words", "width", "mass", F.col("print").alias("item_print"), "b.*")
    met = left.join(right, ["n_words", "width", "block", "value"]).where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= radius)
    pairs = met.select("doc", "start", "n_words", "width", "window_mass", "item", "mass").distinct()
    shared = pairs.join(sets.select("doc", "start", "n_words", "width", "shingle", "weight"), ["doc", "start", "n_words", "width"]).join(item_sets.select("item", "n_words", "width", "shingle"), ["item", "n_words", "width", "shingle"])
    scored = shared.groupBy("doc", "item", "start", "n_words", "window_mass", "mass").agg(F.sum("weight").alias("common"))
    scored = scored.withColumn("similarity", F.col("common") / (F.col("window_mass") + F.col("mass") - F.col("common"))).where(F.col("similarity") >= threshold)
    scored = scored.join(windows.select("doc", "start", "n_words", "aligned"), ["doc", "start", "n_words"])
    best = scored.groupBy("doc", "item").agg(F.max(F.struct("aligned", "similarity", (-F.col("start")).alias("back"), (-F.col("n_words")).alias("less"))).alias("best"))
    return best.select(F.col("doc.id").alias(key), *[F.col("doc.sub")] * hashed, F.col("item").alias(item_key), (-F.col("best.back")).alias("start"), (-F.col("best.less")).alias("n_words"), F.round("best.similarity", 6).alias("similarity"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the documents that leak an item; rows with a null key stay, and so do other texts of a key."""
    leaks = find_leaks(docs, benchmark, key, text, hashed=True).select(F.col(key).alias("id"), "sub").distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(key).cast("long").alias("id"), F.xxhash64(text_of(text)).alias("sub"))
    return rows.join(leaks, ["id", "sub"], "left_anti").select("row.*")
