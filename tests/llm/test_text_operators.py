"""Operators that treat each document by itself."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import binary_ids, piece_dropout, pii, quality, toxicity
from tessera.llm.queries import BYTE_BPE, PIECE_BPE, vocabulary

ODD = ["", None, " ", "\n", "a", "  lead  and  trail  ", "é漢字😀", "▁▁ a▁b", "x" * 5000, "a b\tc d e", "<|endoftext|> it's we'll 12,5"]


def docs(spark, texts, extra=""):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string" + extra)


# Personal data

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def good(kind, m):
    digits = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.split(".")), "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


def base_spans(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in re.finditer(p, text or "") if good(k, m.group())]


PII = [
    "mail a.b@c.de, x@y, a@b.c_d@e.f@g.h", "1.2.3.4 256.1.1.1 1.2.3.4.5 001.002.003.0255", "4111 1111 1111 1111 or 4111-1111-1111-1112 4111111111111111", "+1 (017) 555-7713 +49 1 +4 9",
    "IBAN GB82 WEST 1234 5698 7654 32 but not GB83 WEST 1234 5698 7654 32", "😀 a@b.c 漢 1.1.1.1", "a@b" + ".c" * 3000, "1" * 20000, "1 " * 9000, "+" * 5000 + "1" + "(" * 5000, "a" * 20000 + "@", *ODD,
]


def test_pii_base_spans(spark):
    df = docs(spark, PII).selectExpr("doc_id", "text", "'x' as pii", "1 as spans")
    got = {r.doc_id: r for r in pii.digest(pii.find_pii(df)).collect()}
    for i, t in enumerate(PII):
        want = base_spans(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), t
        assert got[i].n_email == sum(s.startswith("email") for s in want)
        assert [s for s in got[i].spans.split(",") if not s.startswith("iban") and s] == want
    assert got[4].spans == "iban:5:32"
    assert pii.find_pii(docs(spark, []).limit(0)).count() == 0


def test_pii_context_and_redaction(spark):
    df = docs(spark, ["please call +1 (017) 555-7713 now", "zzz +1 (017) 555-7713", None])
    found = pii.find_pii(df)
    scores = [r.pii[0].score for r in found.where("text is not null").orderBy("doc_id").collect()]
    assert scores[0] > scores[1]
    assert [r.text for r in pii.redact(found).orderBy("doc_id").collect()] == ["please call [phone] now", "zzz [phone]", None]


def test_pii_stays_in_the_jvm(spark):
    plan = pii.digest(pii.find_pii(docs(spark, ["a"])))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="a1.@+ -()4_%\n", max_size=60), min_size=20, max_size=20))
def test_pii_random(spark, texts):
    got = pii.digest(pii.find_pii(docs(spark, texts))).collect()
    for r in got:
        assert r.base_sha256 == hashlib.sha256(",".join(base_spans(texts[r.doc_id])).encode()).hexdigest(), texts[r.doc_id]


# Token ids


@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 60000) | st.integers(0, 1), max_size=700))
@settings(deadline=None, max_examples=60)
def test_pack_round_trip(values):
    ids = np.array(values, np.uint64)
    words, firsts = binary_ids.pack(ids)
    assert (binary_ids.unpack(words, firsts, len(ids)) == ids).all()
    assert len(words) <= 2 * len(ids) and len(firsts) == -(-len(ids) // binary_ids.BLOCK)


def test_pack_is_dense():
    words, _ = binary_ids.pack(np.ones(binary_ids.BLOCK, np.uint64))
    assert len(words) <= -(-binary_ids.BLOCK // 60)


@settings(deadline=None, max_examples=150)
@given(st.text(alphabet=st.sampled_from("ab'st ,.\n\t1é漢|<>_ \x1c"), max_size=40) | st.text(max_size=30))
def test_encoder_is_the_library(text):
    text = text.encode("utf-8", "ignore").decode()
    own = binary_ids.encoder(vocabulary(BYTE_BPE))
    assert own.encode(text).tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids


def test_id_files(spark, tmp_path):
    texts = [*ODD, "some words here " * 400]
    df = docs(spark, texts).selectExpr("100 - doc_id as doc_id", "text", "'x' as k", "1 as t")
    shards = binary_ids.write_ids(df, f"file://{tmp_path}/ids", vocabulary(BYTE_BPE), 2, partitions=3)
    rows = binary_ids.read_ids(shards, with_ids=True).orderBy("doc_id").collect()
    own, start = binary_ids.encoder(vocabulary(BYTE_BPE)), 0
    assert len(rows) == len(texts)
    for r in rows:
        want = [*own.tokenizer.encode(texts[100 - r.doc_id] or "", add_special_tokens=False).ids, 2]
        assert (r.ids, r.start, r.n_tokens, r.ids_crc32) == (want, start, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        start += len(want)
    assert binary_ids.encode_documents(df.limit(0), vocabulary(BYTE_BPE)).count() == 0


# Pieces


def test_pieces_without_dropout_are_the_library():
    import sentencepiece

    p, model = piece_dropout.pieces(vocabulary(PIECE_BPE)), sentencepiece.SentencePieceProcessor(model_file=vocabulary(PIECE_BPE))
    texts = [t for t in ODD if t is not None and "▁" not in t] + ["The quick  brown fox\njumps over 1234 lazy dogs. " * 20, "y" * 300 + "é漢" * 50]
    ids, offsets = piece_dropout.encode_texts(p, pa.array(texts), np.zeros(len(texts), np.uint64), 0.0, 0)
    for i, t in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == model.encode(t), t


@settings(deadline=None, max_examples=60)
@given(st.text(max_size=60), st.sampled_from([0.0, 0.1, 0.5, 1.0]), st.integers(0, 5))
def test_pieces_round_trip(text, rate, seed):
    text = text.encode("utf-8", "ignore").decode()
    p = piece_dropout.pieces(vocabulary(PIECE_BPE))
    ids, offsets = piece_dropout.encode_texts(p, pa.array([text, "x"]), np.array([1, 2], np.uint64), rate, seed)
    data, ends = piece_dropout.decode_ids(p, ids, offsets)
    assert data[: ends[1]].tobytes().decode() == text


def test_pieces_of_odd_characters_round_trip():
    p, text = piece_dropout.pieces(vocabulary(PIECE_BPE)), "a\U0010ffff \u2581b\U0010fffe  \u2581\U0010ffff "
    ids, offsets = piece_dropout.encode_texts(p, pa.array([text, "x\U0010ffff"]), np.array([1, 2], np.uint64), 0.2, 0)
    data, ends = piece_dropout.decode_ids(p, ids, offsets)
    assert [data[a:b].tobytes().decode() for a, b in zip(ends, ends[1:])] == [text, "x\U0010ffff"]


def test_merging_in_arrays_is_the_agenda():
    p = piece_dropout.pieces(vocabulary(PIECE_BPE))
    for word in ["▁worthwhile", "▁▁▁a", "▁antidisestablishment", "▁naïveté", "x"]:
        chars = np.array([ord(c) for c in word])
        for key in range(40):
            sym, alive = piece_dropout.merge_many(p, np.pad(chars, (0, 32 - len(chars)))[None], np.array([len(chars)]), np.array([key], np.uint64), 0.3)
            assert piece_dropout.merge_one(p, chars, key, 0.3) == [(int(sym[0, i]), i) for i in np.flatnonzero(alive[0])]


def test_every_occurrence_of_a_word_draws_anew():
    p = piece_dropout.pieces(vocabulary(PIECE_BPE))
    word, n = "worthwhile", 3000
    ids, offsets = piece_dropout.encode_texts(p, pa.array([f"{word} " * n + "x" * 99]), np.array([7], np.uint64), 0.1, 0)
    secret = piece_dropout.mix64(np.array([0], np.uint64) + np.uint64(0x5EED))[0]
    with np.errstate(over="ignore"):
        place = piece_dropout.mix64(piece_dropout.mix64(np.array([7], np.uint64) ^ secret) + np.arange(n).astype(np.uint64))
    keys = piece_dropout.mix64(piece_dropout.hash_strings(pa.array(["▁" + word])) ^ place)
    chars = np.array([ord(c) for c in "▁" + word])
    want = [tuple(s for s, _ in piece_dropout.merge_one(p, chars, int(k), 0.1)) for k in keys]
    assert ids[: sum(map(len, want))].tolist() == [i for x in want for i in x]
    assert len(set(want)) > 12


def test_pieces_query(spark):
    df = docs(spark, [*ODD, "the same words the same words the same words " * 20]).selectExpr("doc_id", "text", "5 as n_tokens")
    first = {r.doc_id: r.ids for r in piece_dropout.encode_pieces(df, vocabulary(PIECE_BPE), 0.3, 1).collect()}
    again = {r.doc_id: r.ids for r in piece_dropout.encode_pieces(df.repartition(3), vocabulary(PIECE_BPE), 0.3, 1).collect()}
    other = {r.doc_id: r.ids for r in piece_dropout.encode_pieces(df, vocabulary(PIECE_BPE), 0.3, 2).collect()}
    plain = {r.doc_id: r.ids for r in piece_dropout.encode_pieces(df, vocabulary(PIECE_BPE), 0.0, 1).collect()}
    assert first == again != other and len(first[len(ODD)]) > len(plain[len(ODD)])
    rows = piece_dropout.encode_pieces(df, vocabulary(PIECE_BPE), 0.3, 1)
    assert rows.where("not lossless").count() == 0
    back = {r.doc_id: r.text for r in piece_dropout.decode_pieces(rows, vocabulary(PIECE_BPE)).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(ODD))


# Classifiers


def sentences(r, n):
    return " ".join("".join(r.choice(list("aeioustrn"), r.integers(2, 8))) for _ in range(n))


def labelled(seed, n):
    r = np.random.default_rng(seed)
    good = [sentences(r, int(r.integers(20, 200))) for _ in range(n)]
    bad = [" ".join(w + "$$$" for w in sentences(r, int(r.integers(20, 200))).split()) for _ in range(n)]
    return good, bad


def test_quality_held_out():
    good, bad = labelled(1, 60)
    model = quality.fit([t.encode() for t in good + bad], np.r_[np.ones(60), np.zeros(60)], steps=120)
    good, bad = labelled(2, 30)
    x = quality.pooled(model, [t.encode() for t in good + bad])
    p = quality._sigmoid(x @ model.head[:-1] + model.head[-1])
    assert (p[:30] > 0.5).mean() > 0.95 and (p[30:] < 0.5).mean() > 0.95


def test_quality_covers_the_whole_text_and_ignores_neighbours():
    r = np.random.default_rng(3)
    model = quality.Model(r.normal(size=(256, quality.DIM)).astype(np.float32), r.normal(size=(quality.WIDTH * quality.DIM, quality.FILTERS)).astype(np.float32), np.zeros(quality.FILTERS, np.float32), np.zeros(2 * quality.FILTERS + 1, np.float32))
    texts = [b"", b"abc", b"x" * 5000, b"hello world " * 300]
    together = quality.pooled(model, texts)
    for i, t in enumerate(texts):
        assert np.allclose(together[i], quality.pooled(model, [t])[0], atol=1e-4)
        padded = t + bytes(-len(t) % quality.STRIDE or (quality.STRIDE if not t else 0)) + bytes(quality.STRIDE)
        steps = len(padded) // quality.STRIDE - 1
        h = np.array([model.embed[np.frombuffer(padded[k * quality.STRIDE : k * quality.STRIDE + quality.WIDTH], np.uint8)].ravel() @ model.filters for k in range(steps)])
        chunks = np.array([np.maximum(h[k : k + quality.CHUNK].max(0), 0) for k in range(0, max(1, steps - quality.CHUNK + quality.HOP), quality.HOP)])
        assert np.allclose(together[i], np.r_[chunks.mean(0), chunks.max(0)], atol=1e-3)


def test_quality_learns_from_the_end_of_long_texts(spark):
    good, bad = labelled(4, 12)
    neutral = " ".join(["same words"] * 2000)  # over 20,000 characters
    texts = [neutral + " " + " ".join([t] * 30) for t in good + bad]
    df = docs(spark, texts)
    labels = spark.createDataFrame([(i, int(i < 12)) for i in range(24)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality.score_quality(df, quality.train(df, labels)).collect()}
    assert all((got[i] > 0.5) == (i < 12) for i in range(24))


def test_quality_query_shapes(spark):
    df = docs(spark, ODD).selectExpr("doc_id", "text", "'a' as score", "1 as label")
    model = quality.fit([], np.zeros(0))
    got = quality.score_quality(df, model).collect()
    assert len(got) == len(ODD) and all(r.score == 0.5 and r.label == 1 for r in got)
    labels = spark.createDataFrame([(0, 1), (None, 0), (4, None)], "doc_id long, quality int")
    assert quality.score_quality(df, quality.train(df.select("doc_id", "text"), labels)).count() == len(ODD)
    assert quality.score_quality(df.limit(0), model).count() == 0


BAD = ["idiot", "scum", "moron", "trash"]


def toxic_rows(seed, n):
    r = np.random.default_rng(seed)
    out = []
    for i in range(n):
        words = sentences(r, 60).split()
        if i % 5 == 0:
            for _ in range(int(r.integers(1, 4))):
                words.insert(int(r.integers(0, 60)), str(r.choice(BAD)) + str(r.choice(["", ".", ","])))
        out.append((i, " ".join(words), int(i % 5 == 0)))
    return out


def test_toxicity_held_out(spark):
    train = toxic_rows(1, 400)
    df = spark.createDataFrame([t[:2] for t in train], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in train], "doc_id long, toxic int")
    index = toxicity.train(df, labels)
    assert set(index.terms.to_pylist()) == {w for i, t, _ in train if zlib.crc32(str(i).encode()) % 4 != 2 for w in plain_words(t)}
    test = toxic_rows(2, 200)
    scored = {r.doc_id: r for r in toxicity.score_toxicity(spark.createDataFrame([t[:2] for t in test], "doc_id long, text string").selectExpr("*", "0 as score"), index).collect()}
    assert np.mean([(scored[i].score >= toxicity.THRESHOLD) == bool(y) for i, _, y in test]) > 0.97
    assert all(scored[i].evidence for i, _, _ in test)
    odd = toxicity.score_toxicity(docs(spark, [*ODD, "漢字 only"]), index).collect()
    assert all(0 <= r.score <= 1 for r in odd) and not any(r.evidence for r in odd if not set(plain_words(r.text)) & set(index.terms.to_pylist()))
    assert toxicity.score_toxicity(df.limit(0), index).count() == 0
    empty = toxicity.train(df, labels.where("toxic = 7"))
    assert toxicity.score_toxicity(df, empty).where("score = 0.5").count() == 400


def plain_words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def test_toxicity_equals_brute_force(spark):
    """Every example against every document by dense vectors over all words; votes of the nearest, ties included."""
    rows = toxic_rows(5, 240)
    rows += [(240 + i, t, y) for i, (_, t, y) in enumerate(rows[:40])]  # copies, which tie
    rows += [(300, None, 0), (301, "", 1), (302, " ".join(rows[0][1] for _ in range(300)), 1), (303, "unheard zzz", None), (304, "it's a don't-idiot IDIOT", 1)]
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    index = toxicity.train(df, labels)
    got = {r.doc_id: r for r in toxicity.score_toxicity(df, index).collect()}
    train = sorted((i, t, y) for i, t, y in ((i, t or "", y) for i, t, y in rows) if y is not None and zlib.crc32(str(i).encode()) % 4 != 2)
    y = np.array([y for _, _, y in train], float)
    terms = sorted({w for _, t, _ in train for w in plain_words(t)})
    place = {w: i for i, w in enumerate(terms)}

    def counted(texts):
        m = np.zeros((len(texts), len(terms)))
        for i, t in enumerate(texts):
            for w in plain_words(t):
                if w in place:
                    m[i, place[w]] += 1
        return m

    every, own = counted([t for _, t, _ in rows]), counted([t for _, t, _ in train])
    idf = np.log((1 + len(rows)) / (1 + (every > 0).sum(0))) + 1
    one, zero = (own[y == 1] > 0).sum(0) + 0.5, (own[y == 0] > 0).sum(0) + 0.5
    z = (np.log(one / (y.sum() + 1)) - np.log(zero / (len(y) - y.sum() + 1))) / np.sqrt(1 / one + 1 / zero)
    weight = idf * (toxicity.FLOOR + np.maximum(z, 0) ** 2)

    def units(m):
        m = np.log1p(m) * weight
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)

    empty = own.sum(1) == 0
    prior = (y[empty].sum() + y.mean()) / (empty.sum() + 1)

    def vote(sims):
        sims = np.round(sims, 9)
        last = np.sort(sims)[-toxicity.K]
        near = (sims >= last) & (sims > 0)
        w = sims[near] ** 2
        return (w @ y[near] + toxicity.PULL * prior) / (w.sum() + toxicity.PULL), near

    among = units(own) @ units(own).T
    np.fill_diagonal(among, 0)
    a, b = toxicity.curve_of(np.array([vote(s)[0] for s, e in zip(among, empty, strict=True) if not e]), y[~empty])
    ids = np.array([i for i, _, _ in train])
    for (i, _, _), sims in zip(rows, units(every) @ units(own).T, strict=True):
        raw, near = vote(sims)
        want = 1 / (1 + np.exp(-(a * raw + b))) if near.any() else prior
        assert abs(got[i].score - want) < 2e-6
        order = np.lexsort((ids, -np.round(sims, 9)))
        assert got[i].evidence == [int(ids[j]) for j in order if near[j]][: toxicity.K]


def test_blocks_that_cannot_hold_a_neighbour_are_not_read():
    texts = [f"group{i // 32} " * 9 + f"own{i} common" for i in range(640)]
    index = toxicity.build(np.arange(640), texts, np.arange(640) // 64 == 3, lambda terms: (np.ones(len(terms)), 640))
    row, term, count = toxicity.count_terms(pa.array(["group6 own200 common"]), index.terms)
    q = index.units(row, term, count, 1)
    who, sim = next(index.search(row, term, q, 1))
    rare, dense = np.zeros((640, len(index.terms))), np.zeros((640, len(index.terms)))
    rare[index.example, np.repeat(np.repeat(np.arange(len(index.terms)), np.diff(index.runs)), np.diff(index.posts))] = index.value
    dense[:, index.common >= 0] = index.rows[index.common[index.common >= 0]].T
    assert len(index.rows) == 1 and not (rare[:, index.common >= 0]).any()
    every = np.round((rare + dense)[:, term] @ q, 9)
    assert index.ids[who[0]] == 200 and (every >= sim[-1]).sum() == len(who) and np.allclose(every[who], sim)
    bounds = np.array([(dense[i : i + toxicity.BLOCK, term] @ q).max() + rare[i : i + toxicity.BLOCK, term].max(0) @ q for i in range(0, 640, toxicity.BLOCK)])
    ahead = np.argsort(-bounds, kind="stable")[:2]
    unread = [b for b in range(len(bounds)) if b not in ahead and bounds[b] < sim[-1] - 1e-6]
    assert len(unread) >= 7
    index.value[np.isin(index.example // toxicity.BLOCK, unread)] = np.nan
    again = next(index.search(row, term, q, 1))
    assert again[0].tolist() == who.tolist() and again[1].tolist() == sim.tolist()


@pytest.mark.parametrize("text", ["Idiot!", "x-idiot|scum", "IDIOT idiot"])
def test_terms_inside_tokens(text):
    found = toxicity.count_terms(pa.array([text, "none", ""]), pa.array(["idiot", "scum"], pa.large_string()))
    assert found[0].tolist()[0] == 0 and 0 in found[1].tolist()
    assert found[2].sum() == len([w for w in plain_words(text) if w in ("idiot", "scum")])
