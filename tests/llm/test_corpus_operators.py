"""Operators that compare documents, against brute force on small tables."""

import hashlib
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest

from tessera.llm import decontaminate, jaccard, lines, media, suffix
from tessera.llm.components import components


def words(r, n, vocabulary=400):
    return [f"w{int(x)}" for x in np.minimum(r.zipf(1.3, n), vocabulary)]


def corpus(seed=0, n=60):
    """Texts of lines with copies, near copies, shared passages and odd ones."""
    r = np.random.default_rng(seed)
    texts = []
    for _ in range(n):
        kind = r.random()
        if texts and kind < 0.15:
            texts.append(texts[int(r.integers(len(texts)))])
        elif texts and kind < 0.45:
            parts = (texts[int(r.integers(len(texts)))] or "a b").split(" ")
            for _ in range(int(r.integers(1, 4))):
                parts[int(r.integers(len(parts)))] = f"n{int(r.integers(1000))}"
            texts.append(" ".join(parts))
        else:
            texts.append("\n".join(" ".join(words(r, int(r.integers(1, 30)))) for _ in range(int(r.integers(1, 6)))))
    return [*texts, None, "", " \n ", "one", "one two", "one two", "a b c d e", "a b c d e", "\n".join(["same line here"] * 5), "x" * 3000]


def table(spark, texts):
    return spark.createDataFrame([(i, t, "k", 1) for i, t in enumerate(texts)], "doc_id long, text string, id string, line int")


def shingles(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def similar(a, b):
    return bool(a and b) and len(a & b) >= 0.8 * len(a | b) - 1e-9


def roots(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    r = np.random.default_rng(0)
    pairs = [(int(a), int(b)) for a, b in r.integers(0, 200, (120, 2))] + [(i, i + 1) for i in range(300, 340)]
    df = spark.createDataFrame([*pairs, (None, 3), (7, 7)], "a long, b long")
    want = roots(400, pairs)
    got = {x.node: x.root for x in components(df).collect()}
    assert got == {i: want[i] for i in {x for a, b in pairs if a != b for x in (a, b)}}
    assert components(df.limit(0)).count() == 0


@pytest.mark.parametrize(("seed", "block"), [(0, 1024), (1, 3)])
def test_jaccard(spark, monkeypatch, seed, block):
    monkeypatch.setattr(jaccard, "BLOCK_NODES", block)
    texts = corpus(seed)
    sets = [shingles(t) for t in texts]
    linked = [(a, b) for a, b in combinations(range(len(texts)), 2) if similar(sets[a], sets[b])]
    want = roots(len(texts), linked)
    degree = [len({sets[b] for b in range(len(texts)) if similar(sets[a], sets[b]) and sets[a] != sets[b]}) for a in range(len(texts))]
    got = {r.doc_id: r for r in jaccard.jaccard_classes(table(spark, texts)).collect()}
    assert len(got) == len(texts)
    assert [got[i].class_id for i in range(len(texts))] == want
    assert [got[i].n_links for i in range(len(texts))] == degree


def test_jaccard_edges(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "A  b\nc d e f")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.class_id) for r in jaccard.jaccard_classes(df).collect())
    assert got == [(0, None), (1, 1), (1, 1), (2, 1)]
    assert jaccard.jaccard_classes(df.limit(0)).count() == 0


def test_posterior_table():
    """A pair at the threshold is dropped with a probability near the tolerance only."""
    from math import comb

    for n, m in jaccard.least_matches(0.8, 1e-6).items():
        assert sum(comb(n, k) * 0.8**k * 0.2 ** (n - k) for k in range(m)) < 1e-4


def later(texts):
    seen, out = [], set()
    for i, t in enumerate(texts):
        for k, line in enumerate((t or "").split("\n")):
            s = frozenset(line.lower().split())
            if s:
                if any(similar(s, y) for y in seen):
                    out.add((i, k))
                seen.append(s)
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_lines(spark, seed):
    texts = corpus(seed)
    assert {(r.doc, r.line) for r in lines.later_lines(table(spark, texts)).collect()} == later(texts)


def test_lines_with_many_near_candidates(spark):
    """Lines whose nearest candidate by bitmap fails, so that the further ones count."""
    r = np.random.default_rng(5)
    base = [f"b{i}" for i in range(20)]
    texts = [" ".join([*r.permutation(base)[: int(r.integers(14, 21))], *(f"u{int(x)}" for x in r.integers(0, 6, 2))]) for _ in range(60)]
    assert {(x.doc, x.line) for x in lines.later_lines(table(spark, texts)).collect()} == later(texts)


def test_line_removal(spark):
    texts = corpus(2)
    gone = later(texts)
    df = table(spark, texts).withColumnRenamed("line", "n_lines")
    for r in lines.dedup_lines(df).collect():
        t = texts[r.doc_id]
        want = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (r.doc_id, k) not in gone)
        assert (r.text, r.n_lines, r.n_removed) == (want, len((t or "").split("\n")), sum(d == r.doc_id for d, _ in gone))
    null = spark.createDataFrame([(None, "a b c"), (1, "a b c")], "doc_id long, text string")
    assert sorted(r.text for r in lines.dedup_lines(null).collect()) == ["a b c", "a b c"]
    assert lines.dedup_lines(null.limit(0)).count() == 0


def stripped(rows):
    seen, out = set(), {}
    for key, text in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(b[i : i + 100])
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out[key] = (len(b), len(b) - len(kept), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("shard", [1 << 20, 600])
def test_suffix(spark, monkeypatch, shard):
    monkeypatch.setattr(suffix, "SHARD", shard)
    r = np.random.default_rng(4)
    text = lambda n: "".join(r.choice(list("abcdé 漢"), n))
    passages = [text(150), text(300), text(99), text(100)]
    rows = []
    for i in range(40):
        parts = [text(int(r.integers(0, 400)))]
        for _ in range(int(r.integers(0, 3))):
            p = passages[int(r.integers(4))]
            a = int(r.integers(0, 30))
            parts += [p[a : len(p) - int(r.integers(0, 30))], text(int(r.integers(0, 120)))]
        rows.append((i, "".join(parts)))
    rows += [(50, rows[3][1]), (51, rows[3][1]), (52, None), (53, ""), (54, "x" * 1000), (55, "xy" * 300), (56, "a" * 99), (57, "x" * 101), (None, rows[5][1]), (58, ("q" * 120 + "z" * 130) * 3)]
    df = spark.createDataFrame([(*x, "c") for x in rows], "doc_id long, text string, kept string").repartition(5)
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix.strip_repeats(df).collect()}
    assert got == stripped(rows)
    assert suffix.strip_repeats(df.limit(0)).count() == 0


def test_repeated_rows_stay_alike(spark):
    df = spark.createDataFrame([(1, "ab" * 40 + "c" * 90)] * 2 + [(2, "z" * 50)], "doc_id long, text string")
    got = [(x.doc_id, x.n_removed) for x in suffix.strip_repeats(df.repartition(3)).collect()]
    assert sorted(got) == [(1, 0), (1, 0), (2, 0)]


def test_suffix_array():
    r = np.random.default_rng(0)
    for _ in range(20):
        codes = r.integers(0, 4, int(r.integers(1, 200))).astype(np.int16)
        order = suffix.suffix_array(codes)
        assert order.tolist() == sorted(range(len(codes)), key=lambda i: codes[i:].tolist())
        shared = suffix.common_prefixes(codes, order, 50)
        for k in range(1, len(codes)):
            a, b = codes[order[k - 1] :], codes[order[k] :]
            m = min(len(a), len(b))
            n = int(np.argmin(a[:m] == b[:m])) if not (a[:m] == b[:m]).all() else m
            assert shared[k] == min(n, 50)


def leaks(docs, items, threshold=0.8):
    w = lambda t: (t or "").lower().split()
    items = {i: w(t) for i, t in items if i is not None and w(t)}
    part = lambda x, n: [tuple(x[k : k + n]) for k in range(len(x) - n + 1)]
    width = {i: min(5, len(x)) for i, x in items.items()}
    having = defaultdict(set)
    for i, x in items.items():
        for s in part(x, width[i]):
            having[s].add(i)
    weight = lambda s: round(1000 * np.log(1 + len(items) / len(having[s]))) if s in having else round(1000 * np.log(1 + len(items)))
    out = {}
    for d, t in docs:
        x = w(t)
        for i, y in items.items():
            own = set(part(y, width[i]))
            starts = {max(0, min(p - o, len(x) - len(y))) for p, s in enumerate(part(x, width[i])) for o, q in enumerate(part(y, width[i])) if s == q}
            for a in sorted(starts):
                win = set(part(x[a : a + len(y)], width[i]))
                both = sum(map(weight, win & own)) / sum(map(weight, win | own))
                if both >= threshold and (d, i) not in out or both > out.get((d, i), (2,))[0]:
                    out[d, i] = (both, a)
    return {k: (a, round(s, 6)) for k, (s, a) in out.items()}


def test_leaks(spark):
    r = np.random.default_rng(6)
    items = [(i, " ".join(words(r, int(n)))) for i, n in enumerate([20, 20, 35, 60, 3, 5])] + [(10, None), (11, ""), (None, "a b c d e f")]
    docs = []
    for i in range(30):
        x = words(r, int(r.integers(0, 120)))
        if i % 2:
            y = items[int(r.integers(6))][1].split()
            if i % 4 == 1 and len(y) > 30:
                y[int(r.integers(len(y)))] = "changed"
            at = int(r.integers(0, len(x) + 1))
            x = x[:at] + [v.upper() for v in y] + x[at:]
        docs.append((i, " ".join(x)))
    docs += [(40, None), (41, ""), (42, items[0][1]), (43, items[3][1][:-20])]
    df = spark.createDataFrame([(*d, "x", 0) for d in docs], "doc_id long, text string, start string, n_words int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id): (x.start, x.similarity) for x in decontaminate.find_leaks(df, bench).collect()}
    assert got == leaks(docs, items)
    assert {x.doc_id for x in decontaminate.decontaminate(df, bench).collect()} == {d for d, _ in docs} - {d for d, _ in got}
    assert decontaminate.find_leaks(df, bench.limit(0)).count() == 0 and decontaminate.find_leaks(df.limit(0), bench).count() == 0


def test_leaks_in_another_order(spark):
    """A passage that holds an item's words in another order shares no alignment with it at the best window."""
    r = np.random.default_rng(11)
    items = [(i, [f"i{i}_{k}" for k in range(n)]) for i, n in enumerate([45, 50, 58])]
    docs = []
    for i, y in items:
        for cut in (len(y) // 4, len(y) // 3, len(y) // 2):
            pad = [f"p{int(x)}" for x in r.integers(0, 1000, 90)]
            docs.append((len(docs), i, pad[:40] + y[cut:] + y[:cut] + pad[40:]))
    sets = lambda x: {tuple(x[k : k + 5]) for k in range(len(x) - 4)}
    want = {}
    for d, i, x in docs:  # shingles have one item each, or none: all weigh alike but for what no item has
        own, some, none = sets(items[i][1]), round(1000 * np.log(1 + 3)), round(1000 * np.log(1 + 3))
        for a in range(len(x) - len(items[i][1]) + 1):
            win = sets(x[a : a + len(items[i][1])])
            both = some * len(win & own) / (some * len(own) + none * len(win - own))
            if both >= 0.8 and both > want.get((d, i), (0, 0))[1]:
                want[d, i] = (a, both)
    assert len(want) == len(docs)
    df = spark.createDataFrame([(d, " ".join(x)) for d, _, x in docs], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(y)) for i, y in items], "item_id long, text string")
    got = {(x.doc_id, x.item_id): (x.start, x.similarity) for x in decontaminate.find_leaks(df, bench).collect()}
    assert got == {k: (a, round(s, 6)) for k, (a, s) in want.items()}


def test_images(spark):
    r = np.random.default_rng(7)
    pictures = {i: media.render(r.normal(0, 0.13, 64)) for i in range(30)}
    edited = {i: media.edit(pictures[i], i) for i in range(0, 30, 3)}
    edited[1] = np.rot90(pictures[1])
    rows = [(i, media.encode_image(p)) for i, p in pictures.items()] + [(100, media.encode_image(pictures[0])), (101, None), (102, b"junk"), (103, media.encode_image(np.zeros((50, 50), np.uint8))), (None, media.encode_image(pictures[2]))]
    images = spark.createDataFrame([(*x, "same") for x in rows], "id long, image binary, same string")
    queries = spark.createDataFrame([(i, bytearray(media.encode_image(p))) for i, p in edited.items()], "id long, image binary")
    got = {(x.query_id, x.class_id): (x.n_images, x.n_inliers) for x in media.find_copies(queries, images).collect()}
    assert set(got) == {(i, i) for i in edited}
    assert got[0, 0][0] == 2
    assert media.find_copies(queries.limit(0), images).count() == 0


def test_image_files():
    pixels = np.arange(12, dtype=np.uint8).reshape(3, 4)
    assert (media.decode_image(media.encode_image(pixels)) == pixels).all()
    assert media.decode_image(b"P5\n4 4\n255\nxx") is None and media.decode_image(None) is None


def turned(pixels, degrees):
    a, (h, w) = np.deg2rad(degrees), pixels.shape
    y, x = np.mgrid[0:h, 0:w] - np.array([(h - 1) / 2, (w - 1) / 2])[:, None, None]
    sx, sy = np.cos(a) * x - np.sin(a) * y + (w - 1) / 2, np.sin(a) * x + np.cos(a) * y + (h - 1) / 2
    return pixels[np.clip(np.rint(sy), 0, h - 1).astype(int), np.clip(np.rint(sx), 0, w - 1).astype(int)]


EDITS = {
    **{f"scaled {f}": lambda p, f=f: np.rint(media.resize(media._box(p.astype(float), 1) if f < 1 else p.astype(float), int(96 * f), int(96 * f))).astype(np.uint8) for f in (0.5, 0.6, 0.75, 1.33, 1.5)},
    "middle half": lambda p: p[24:72, 24:72], "quarter turn": np.rot90, "turned by 30": lambda p: turned(p, 30), "blurred": lambda p: np.rint(media._box(p.astype(float), 1)).astype(np.uint8),
}


@pytest.mark.parametrize("name", EDITS)
def test_recall_of_edited_pictures(name):
    """At least nine of ten copies are found, and nothing else, in tables without Spark."""
    r = np.random.default_rng(3)
    pictures = [media.render(r.normal(0, 0.13, 64)) for _ in range(60)]
    held = [media.describe(p) for p in pictures]
    tables = media._Tables([media.describe(np.ascontiguousarray(EDITS[name](p))).tobytes() for p in pictures[:30]])
    corners, image = np.concatenate(held), np.repeat(np.arange(60), [len(h) for h in held])
    q, who, _ = tables.copies(corners, image, *tables.matches(corners))
    assert sum(q == who) >= 27 and sum(q != who) <= 1


def test_matches_against_all_pairs():
    """Every pair of descriptors within seven bits is found, and none beyond NEAR; frequent values included."""
    r = np.random.default_rng(4)
    base = r.integers(0, 1 << 63, (40, 2)).astype(np.uint64)
    corners = np.zeros(4000, media.CORNER)
    for k, c in enumerate(("d0", "d1")):
        flips = np.zeros(4000, np.uint64)
        for _ in range(4):
            flips ^= np.uint64(1) << r.integers(0, 64, 4000).astype(np.uint64)
        corners[c] = base[r.integers(0, 40, 4000) if k == 0 else 0, k] ^ flips
    a, b = corners[:1500], corners[1500:]
    gap = sum(np.bitwise_count(a[c][:, None] ^ b[c][None]).astype(int) for c in ("d0", "d1"))
    i, j = media._Tables([a.tobytes()]).matches(b)
    got = set(zip(i.tolist(), j.tolist()))
    assert len(got) == len(i) and set(zip(*(x.tolist() for x in np.nonzero(gap <= 7)))) <= got <= set(zip(*(x.tolist() for x in np.nonzero(gap <= media.NEAR))))


def test_lines_of_frequent_words(spark, monkeypatch):
    """Frequent words are posted in pairs, those of long lines one by one; both find every similar line."""
    monkeypatch.setattr(lines, "FREQUENT", 9)
    monkeypatch.setattr(lines, "LONG", 12)
    texts = corpus(4)
    assert {(r.doc, r.line) for r in lines.later_lines(table(spark, texts)).collect()} == later(texts)


def test_lines_of_repeated_keys(spark):
    """A key with several texts: each loses its own lines; rows that are wholly equal are one document."""
    rows = [(1, "alpha beta gamma"), (2, "alpha beta gamma\nkeep one two"), (2, "unique words here now\nother line entirely"), (3, "x y z"), (3, "x y z"), (4, " ".join(f"w{i % 3000}" for i in range(40000)) + "\nx y z")]
    got = sorted((r.doc_id, r.text, r.n_removed) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = [(1, rows[0][1], 0), (2, "keep one two", 1), (2, rows[2][1], 0), (3, "x y z", 0), (3, "x y z", 0), (4, rows[5][1].split("\n")[0], 1)]
    assert got == sorted(want)


def test_joins_of_lines_build_no_bloom_filters(spark, monkeypatch, tmp_path):
    """Spark would merge them in one task and send them out with every task, though the sets are those of the pairs."""
    plans, own = [], lines.cut
    monkeypatch.setattr(lines, "cut", lambda df: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), own(df))[1])
    sizes = {"spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for name, value in sizes.items():  # small tables are joined as large ones are
        spark.conf.set(name, value)
    try:
        texts = ["a b c d e f g h i j", "a b c d e f g h i k", "other words stand here"]
        table(spark, texts).write.parquet(f"{tmp_path}/documents")  # a table of known size
        got = {(r.doc, r.line) for r in lines.later_lines(spark.read.parquet(f"{tmp_path}/documents")).collect()}
    finally:
        for name in sizes:
            spark.conf.unset(name)
    assert got == later(texts)
    assert any("Join" in p for p in plans)
    assert not any("might_contain" in p for p in plans)


def test_texts_without_lines_to_verify_are_not_shuffled(spark, monkeypatch):
    """Of the texts only those that may have such lines go on to the join with them; none that has is left out."""
    monkeypatch.setattr(lines, "BROADCAST", 0)
    plans, own = [], lines.cut
    monkeypatch.setattr(lines, "cut", lambda df: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), own(df))[1])
    texts = corpus(6)
    assert {(r.doc, r.line) for r in lines.later_lines(table(spark, texts)).collect()} == later(texts)
    sets = [p for p in plans if "wanted" in p and "MapInArrow" in p]
    assert sets and all("bits" in p for p in sets)
    docs = spark.range(3000).selectExpr("id", "hash(id) * 3L as sub", "'x' as t")
    ends = docs.where("id % 50 = 0").select("id", "sub")
    kept = {r.id for r in lines._may_be_in(docs, ends, 3).collect()}
    assert set(range(0, 3000, 50)) <= kept and len(kept) < 70


@pytest.mark.parametrize(("seed", "slice_", "tile"), [(0, 7, 5), (1, 1 << 14, 1 << 20)])
def test_candidates_of_a_bucket(monkeypatch, seed, slice_, tile):
    """Those named are of the nearest that pass, and `every` names all of the lines asked for; near and far, by slices or one by one."""
    monkeypatch.setattr(lines, "SLICE", slice_)
    monkeypatch.setattr(lines, "TILE", tile)
    r, n = np.random.default_rng(seed), 300
    rows = {"key": r.integers(0, 3, n), "same": r.integers(0, 1 << 40, n), "b1": r.integers(0, 8, n), "b2": r.integers(0, 4, n), "line": r.integers(0, 3, n), "size": r.integers(5, 30, n), "place": r.integers(0, 2, n), "doc": r.integers(0, 99, n), "sub": np.arange(n)}
    asked = {c: rows[c][:20] if c in ("key", "doc", "sub", "line") else np.zeros(20, np.int64) for c in rows}
    met = lines._Bucket({c: [np.concatenate([rows[c], asked[c]]).astype(kind).tobytes()] for c, kind in lines.PACKED.items()}, 0.8)
    x, y = np.divmod(np.arange(n * n), n)
    x, y = x[(y >= met.lo[x]) & (y < met.hi[x])], y[(y >= met.lo[x]) & (y < met.hi[x])]
    ok = met.passes(x, y)
    want = defaultdict(set)
    for a, b in zip(x[ok].tolist(), y[ok].tolist()):
        want[a].add(b)
    i, j, more = met.first(4)
    got = defaultdict(list)
    for a, b in zip(i.tolist(), j.tolist()):
        got[a].append(b)
    assert got.keys() == want.keys()
    for a, found in got.items():
        assert len(found) == len(set(found)) == min(4, len(want[a])) and set(found) <= want[a]
        assert sorted(abs(b - a) for b in found) == sorted(abs(b - a) for b in want[a])[: len(found)]
    assert (more == np.array([len(got[a]) >= 4 for a in i.tolist()])).all()
    pairs = [(a, b) for e in met.every() for a, b in zip(e[0].tolist(), e[1].tolist())]
    own = {k for k in range(n) if met.rows["sub"][k] < 20}
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(a, b) for a in own for b in want[a]}
