"""The training-data operators against the libraries they follow, brute force and SQL, with the awkward rows each must take."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sylvan.llm import bpe, common, entry, graph, op1_tokens, op2_quality, op3_toxicity, op4_neighbours, op5_leaks, op6_ids, op7_urls, op8_licenses, op9_jaccard, op10_mix
from sylvan.llm import shingles as sh
from tests.conftest import SMALL, duck_rows, rows_of

DOC = "doc_id long, text string, lang string, source string, score string, size string"
ODD = [None, "", " ", "\n\t", "x" * 30_000, "a b " * 9_000, "é́ ß İ Σς   \x1c\x85", "<|endoftext|> a<|startoftext|>b<|endoftext|>", "don't we'll  I'm\r\n 12³½ 漢字 😀😀"]


def odd_docs(spark):
    """Null ids and texts, repeated rows, and columns named as the operators' own."""
    rows = [(i, t, "en", f"s{i % 3}" if i % 4 else None, "1", "2") for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows + [rows[7], rows[8], (None, "no id", None, None, None, None)], DOC)


@pytest.fixture(scope="module")
def texts(spark):
    return [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()] + [t or "" for t in ODD]


@pytest.mark.parametrize("name", ["op7_url_filter", "op8_license_scan", "op10_source_mix"])
def test_sql(spark, duck, name):
    assert rows_of(entry.queries()[name](spark, SMALL)) == duck_rows(duck, entry.oracle_sql()[name])


# 1 and 6: tokens


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_tokens_are_the_librarys(texts, file):
    path = common.tokenizer_path(file)
    expected = [e.ids for e in bpe.library(path).encode_batch(texts, add_special_tokens=False)]
    if file.startswith("byte"):
        counter = op1_tokens.Counter(bpe.merger(path))
        assert [counter.count(t) for t in texts] == [len(x) for x in expected]
    else:
        encoder = op6_ids.Encoder(bpe.merger(path))
        assert [np.frombuffer(encoder.encode(t), "<u4").tolist() for t in texts] == expected


def test_every_code_point_tokenizes_as_in_the_library():
    points = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x10000, 7), *range(0x10000, 0x20000, 41)]]
    mixed = [f"a{c} {c}b1{c}{c}" for c in points]
    a, b = (bpe.merger(common.tokenizer_path(f)) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))
    counter, encoder = op1_tokens.Counter(a), op6_ids.Encoder(b)
    for t, n, ids in zip(mixed, bpe.library(a.path).encode_batch(mixed, add_special_tokens=False), bpe.library(b.path).encode_batch(mixed, add_special_tokens=False), strict=True):
        assert counter.count(t) == len(n.ids), repr(t)
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == ids.ids, repr(t)


def test_whole_tokens_are_proven_and_the_rest_is_merged():
    m = bpe.merger(common.tokenizer_path("byte_bpe_50k.json"))
    r = random.Random(1)
    for _ in range(3000):
        piece = bytes(r.choice(b"etaoinshrdlu THE0.,\xc3\xa9") for _ in range(r.randint(1, 14)))
        assert m.pieces(piece) == [m.vocab[s] for s in m.merge(piece)]


def test_memo_forgets_but_stays_right():
    memo = bpe.Recent(lambda k: k * 2, 10)
    assert all(memo[str(k % 37)] == 2 * str(k % 37) for k in range(500)) and len(memo) + len(memo.older) <= 10
    assert memo["x" * 65] == "x" * 130 and "x" * 65 not in memo


def test_count_rows(spark):
    out = op1_tokens.count_tokens(odd_docs(spark), common.tokenizer_path("byte_bpe_50k.json")).collect()
    assert len(out) == len(ODD) + 3
    by = {r.doc_id: r for r in out}
    assert (by[0].n_bytes, by[0].n_tokens, by[0].over_limit) == (0, 0, False) and by[4].n_bytes == 30_000 and None in by
    assert op1_tokens.count_tokens(odd_docs(spark).limit(0), common.tokenizer_path("byte_bpe_50k.json")).count() == 0


def test_id_files_hold_the_documents_in_order(spark):
    docs, path, file = odd_docs(spark), common.fresh_path(spark, "t6"), common.tokenizer_path("word_bpe_49k.json")
    op6_ids.write_ids(docs, path, file, files=3)
    library = bpe.library(file)
    expected = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    at, rows = 0, []
    for doc_id, text in expected:
        ids = library.encode(text, add_special_tokens=False).ids + [1]
        rows.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    out = [tuple(r) for r in op6_ids.digest(spark, path).collect()]
    assert sorted(out, key=lambda r: r[1]) == rows
    assert [r.doc_id for r in op6_ids.read_ids(spark, path, [5]).collect()] == [5]
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,5)]" in op6_ids.read_ids(spark, path, [5])._jdf.queryExecution().toString()
    empty = common.fresh_path(spark, "t6")
    op6_ids.write_ids(docs.limit(0), empty, file)
    assert op6_ids.digest(spark, empty).count() == 0


# 2 and 3: classifiers


def held_out(spark, scored, label):
    rows = scored.join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").collect()
    return np.mean([r.predicted == r[label] for r in rows]), rows


def test_quality_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    share, rows = held_out(spark, op2_quality.query(spark, d), "quality")
    assert share > 0.9 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_toxicity_on_held_out_rows(spark):
    share, rows = held_out(spark, op3_toxicity.query(spark, "/root/testdata/sf0.01"), "toxic")
    assert share > 0.9 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


@pytest.mark.parametrize(("score", "label"), [(op2_quality.score_quality, "quality"), (op3_toxicity.score_toxicity, "toxic")])
def test_classifiers_take_awkward_rows(spark, score, label):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(9)] + [(None, 1, 1), (3, None, None), (3, 0, 0)], "doc_id long, quality int, toxic int")
    docs = odd_docs(spark)
    out = score(docs, labels).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out) and not next(r for r in out if r.doc_id is None).held_out
    assert score(docs.limit(0), labels).count() == 0
    assert score(docs, labels.limit(0)).count() == docs.count()
    assert len({r.score for r in score(docs, labels.where(f"{label} = 1")).collect()}) == 1


def test_folds_follow_crc32(spark):
    df = spark.range(50).select(F.col("id"), common.remainder(F.col("id"), 4).alias("r"))
    assert all(r.r == zlib.crc32(str(r.id).encode()) % 4 for r in df.collect())


def test_ranking_and_calibration_by_themselves():
    r = np.random.default_rng(0)
    x = r.normal(size=(800, 3))
    y = (x[:, 0] + 0.1 * r.normal(size=800) > 0.3).astype(int)
    assert np.mean((op2_quality.Ranker(x, y).score(x) >= 0.7) == y) > 0.9
    raw, level = op3_toxicity.isotonic(np.array([3.0, 1, 2, 4, 2.5]), np.array([1, 0, 1, 1, 0]))
    assert (np.diff(level) > 0).all() and (np.diff(raw) > 0).all()
    inside = (abs(x[:, 0]) < 0.5).astype(float)
    assert np.mean((op3_toxicity.Trees(x, inside).raw(x) > 0) == inside) > 0.95


def test_ranker_is_at_the_optimum_of_its_loss(monkeypatch):
    """Its gradient is that of finite differences, and a slow plain descent on the same pairs ends where it does."""
    r = np.random.default_rng(1)
    x = r.normal(size=(300, 2))
    y = (x[:, 0] - 0.5 * x[:, 1] + r.normal(size=300) > 0).astype(int)
    monkeypatch.setattr(op2_quality, "PAIRS", 2000)
    m = op2_quality.Ranker(x, y, steps=1500)
    z, rng = m._bins(x).astype(float), np.random.default_rng(7)
    i, j = rng.choice(np.flatnonzero(y == 1), 2000), rng.choice(np.flatnonzero(y == 0), 2000)
    d = z[i] - z[j]
    loss = lambda w: np.mean(np.log1p(np.exp(-(d @ w)))) + 0.5e-4 * w @ w
    step = np.eye(len(m.weights)) * 1e-5
    numeric = np.array([(loss(m.weights + e) - loss(m.weights - e)) / 2e-5 for e in step])
    assert abs(numeric).max() < 2e-3
    slow = np.zeros(len(m.weights))
    for _ in range(4000):
        slow += 2.0 * (d.T @ (1 / (1 + np.exp(d @ slow))) / len(d) - 1e-4 * slow)
    assert loss(m.weights) <= loss(slow) + 1e-4
    # the cut lies at the bad rows' share of the scores
    assert abs(np.mean(z @ m.weights < m.at) - np.mean(y == 0)) < 0.01


def test_each_split_is_that_of_an_exhaustive_search():
    r = np.random.default_rng(2)
    x = r.normal(size=(250, 3)).round(1)
    g, h = r.normal(size=250), r.uniform(0.1, 0.25, size=250)
    t = op3_toxicity.Trees(x, (x[:, 0] > 0).astype(float), trees=0)
    b = t._bins(x)
    feature, limit, value = t._grow(b, g, h, 32, 1.0, 2.0)
    node = np.zeros(250, int)
    gain = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1.0)
    for level in range(t.depth):
        for k in range(1 << level):
            own = node == k
            every = [(gain(own & (b[:, f] <= c)) + gain(own & (b[:, f] > c)) - gain(own), f, c) for f in range(3) for c in range(32) if h[own & (b[:, f] <= c)].sum() >= 2 and h[own & (b[:, f] > c)].sum() >= 2]
            best = max((x[0] for x in every), default=0.0)
            f, c = feature[level][k], limit[level][k]
            made = gain(own & (b[:, f] <= c)) + gain(own & (b[:, f] > c)) - gain(own)
            assert abs(max(best, 0) - made) < 1e-9
        node = node * 2 + (b[np.arange(250), feature[level][node]] > limit[level][node])
    assert all(abs(value[k] - g[node == k].sum() / (h[node == k].sum() + 1.0)) < 1e-12 for k in range(8) if (node == k).any())


def test_isotonic_is_the_min_max_formula():
    r = np.random.default_rng(3)
    for n in (1, 2, 7, 40):
        raw, y = r.permutation(n).astype(float), r.integers(0, 2, n).astype(float)
        knots, levels = op3_toxicity.isotonic(raw, y)
        s = y[np.argsort(raw)]
        exact = [max(min(s[a : b + 1].mean() for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
        # knots stand at the means of their blocks, which hold equal levels
        assert sorted(set(np.round(exact, 12))) == sorted(set(np.round(levels, 12)))
        blocks = [np.flatnonzero(np.isclose(exact, v)) for v in sorted(set(exact))]
        assert np.allclose(knots, [b.mean() for b in blocks])


def test_lexicon_finds_disguised_words():
    f = dict(zip(op3_toxicity.NAMES, op3_toxicity.features(["You are an 1d1ot, really", ""], {"idiot": 3.0})[0], strict=True))
    assert f["lexicon_kinds"] == 1 and f["you"] > 0 and not op3_toxicity.features([""], {"idiot": 3.0}).any()


# 4: neighbours


def test_recall_and_exact_scores(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    out = op4_neighbours.query(spark, "/root/testdata/sf0.01").collect()
    ids = [r.vec_id for r in vectors.collect()]
    x = {r.vec_id: np.array(r.embedding, float) for r in vectors.collect()}
    got = defaultdict(list)
    for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    hit = total = 0
    for q in (i for i in ids if i % 20 == 0):
        true = sorted(((-float(x[q] @ x[i]), i) for i in ids if i != q))[:20]
        hit, total = hit + len({i for _, i in true} & {v for _, v, _ in got[q]}), total + 20
        assert [k for k, _, _ in got[q]] == list(range(1, 21))
        assert all(abs(s - x[q] @ x[v]) < 1e-12 for _, v, s in got[q])
    assert hit / total >= 0.9


def test_awkward_vectors(spark):
    v = [1.0, 2.0]
    rows = [(0, v), (20, [1.0, 2.0]), (1, v), (2, v), (3, [2.0, -1.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [1.0, None]), (8, [1.0, float("nan")]), (9, [float("inf"), 1.0]), (10, [1.0, 2.0, 3.0]), (None, v), (1, v)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string")
    out = [tuple(r) for r in op4_neighbours.nearest(df).orderBy("query_id", "rank").select("query_id", "rank", "vec_id", "score").collect()]
    assert out == [(0, 1, 1, 5.0), (0, 2, 2, 5.0), (0, 3, 20, 5.0), (0, 4, 3, 0.0), (20, 1, 0, 5.0), (20, 2, 1, 5.0), (20, 3, 2, 5.0), (20, 4, 3, 0.0)]
    assert op4_neighbours.nearest(df.limit(0)).count() == 0


def brute_neighbours(rows, every, k):
    first = {}
    for i, v in rows:
        first[i] = min(first.get(i, v), v)
    x = {i: np.array(v, float) for i, v in first.items()}
    return {(q, n + 1, i) for q in x if q % every == 0 for n, (_, i) in enumerate(sorted((-float((x[q] * x[i]).sum()), i) for i in x if i != q)[:k])}


def test_slices_and_blocks_lose_nothing(spark):
    """Going up to the roots gives the exact answer, over several slices, copies that fill some of them and blocks of queries."""
    r = np.random.default_rng(2)
    some = [[float(np.float32(a)) for a in v] for v in r.normal(size=(260, 6))]
    near = [[float(np.float32(a)) for a in np.array(some[0]) * (1 + 1e-4 * j)] for j in range(120)]  # one hash string
    rows = list(enumerate(some + [some[1]] * 150 + near))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    out = op4_neighbours.nearest(df, every=3, k=7, trees=3, share=3.0, slice_rows=40, block_queries=25).collect()
    assert {(x.query_id, x["rank"], x.vec_id) for x in out} == brute_neighbours(rows, 3, 7)


def test_recall_over_many_slices_and_the_share_that_is_gathered(spark):
    r = np.random.default_rng(3)
    centres = r.normal(size=(60, 48))
    for name, v, share, most in (("clustered", centres[r.integers(0, 60, 6000)] + 0.35 * r.normal(size=(6000, 48)), 0.08, 0.15), ("random", r.normal(size=(6000, 48)), op4_neighbours.SHARE, 2.3)):
        v = v / np.linalg.norm(v, axis=1)[:, None]
        df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
        out, levels = op4_neighbours._search(df, every=40, share=share, slice_rows=700)
        got = {(x.query_id, x["rank"], x.vec_id) for x in out.collect()}
        true = {(q, i) for q in range(0, 6000, 40) for i in np.argsort(-np.where(np.arange(6000) == q, -9, v @ v[q]), kind="stable")[:20].tolist()}
        recall = len(true & {(q, i) for q, _, i in got}) / len(true)
        gathered = np.mean([x.gathered for x in levels.collect()]) / 6000
        assert recall >= 0.9 and gathered <= most, (name, recall, gathered)


def test_cuts_hold_every_string_where_ranges_look_for_it():
    r = np.random.default_rng(4)
    h = np.r_[r.integers(0, 2**63, 500).astype(np.uint64) * np.uint64(2), np.full(700, 2**63 + 5, np.uint64)][:, None]
    cuts = op4_neighbours.Cuts(h, len(h), 60)
    at = cuts.slice_of(0, h[:, 0], r.integers(0, 10**6, len(h)))
    assert len(set(at[500:].tolist())) > 5 and np.bincount(at).max() < 240
    for depth in (0, 1, 3, 7, 20, 63, 64):
        low, high = op4_neighbours.prefix_range(h[:, 0], depth)
        first, last = cuts.touched(0, low, high)
        for j in range(0, len(h), 37):
            inside = (h[:, 0] >= low[j]) & (h[:, 0] <= high[j])
            assert inside[j] and (at[inside] >= first[j]).all() and (at[inside] <= last[j]).all()


# 5: leaks


def brute_leaks(docs, items):
    """Every window of every item's size, by exact weighted similarity."""
    def grams(w, width):
        return [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)]

    words = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    width = lambda w: min(5, len(w))
    df = defaultdict(int)
    for _, t in items:
        for g in set(grams(x := words(t), width(x))) if words(t) else ():
            df[g] += 1
    w = lambda s: sum(1 + np.log(len(items) / df[g]) if g in df else 1 + np.log(len(items) + 1) for g in s)
    out = set()
    for d, t in docs:
        have = words(t)
        for k, item in items:
            whole = words(item)
            n = len(whole)
            a = set(grams(whole, width(whole))) if n else set()
            for s in range(max(1, len(have) - n + 1)) if n and have else ():
                b = set(grams(have[s : s + n], width(whole)))
                if a & b and w(a & b) / w(a | b) >= 0.75 - 1e-9:
                    out.add((d, k))
    return out


def test_leaks_are_those_of_brute_force(spark):
    r = random.Random(2)
    vocab = [f"w{i}" for i in range(300)]
    say = lambda n: [r.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(say(r.randint(1, 40)))) for i in range(25)] + [(90, None), (91, ""), (92, "Short one"), (93, "w1 w1 w1 w1 w1 w1 w1 w1"), (94, "short item")]
    items += [(95 + i, "the same long question text stands before every answer of this set so that most of it is shared by all " + " ".join(say(4))) for i in range(4)]
    docs = []
    for i in range(120):
        w = say(r.randint(0, 120))
        if i % 2:
            item = r.choice(items[:25])[1].split()
            for _ in range(i % 5):
                item[r.randrange(len(item))] = "changed" if i % 3 else item[0]
            w[len(w) // 2 : len(w) // 2] = [x.upper() + ("," if i % 4 else "") for x in item]
        docs.append((i, " ".join(w)))
    docs += [(500, None), (501, ""), (502, "short ONE!"), (503, items[0][1]), (503, items[0][1]), (None, items[1][1]), (504, "well now the short item is here"), (505, "w1 " * 30), (506, items[-1][1])]
    d = spark.createDataFrame([(*x, "z") for x in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame([(*x, "z") for x in items], "item_id long, text string, doc_id string")
    found = op5_leaks.find_leaks(d, b).collect()
    expected = brute_leaks(docs, items)
    assert {(x.doc_id, x.item_id) for x in found} == expected and len(expected) > 10
    assert {x.doc_id for x in op5_leaks.without_leaks(d, b).collect()} == {x for x, _ in docs} - {x for x, _ in expected}
    assert op5_leaks.find_leaks(d.limit(0), b).count() == 0 and op5_leaks.find_leaks(d, b.limit(0)).count() == 0
    chunked = [m for c in op5_leaks.chunks(b, 200) for m in c.matches(items[1][1].encode())]
    assert 1 in {m[0] for m in chunked} and len(list(op5_leaks.chunks(b, 200))) > 1


def packed_items(texts):
    hs = [np.unique(op5_leaks.shingled(t.encode())[0]) for t in texts]
    return op5_leaks.Items([(i, t.encode(), h, np.ones(len(h), np.int64)) for i, (t, h) in enumerate(zip(texts, hs, strict=True))], len(texts))


@pytest.mark.parametrize("groups", [1, 4])
def test_all_fingerprints_within_the_radius_are_found(groups):
    r = random.Random(4)
    items = packed_items([" ".join(r.choice("abcdefghij") * 3 + str(r.randint(0, 50)) for _ in range(20 + i % 2)) for i in range(60)])
    if groups > 1:
        items.ids = [*items.ids] * (groups << 12)
        items._list()
        items.ids = items.ids[:60]
        assert items.groups == groups or items.groups == 16
    prints = []
    for _ in range(300):
        f = items.prints[r.randrange(60)].copy()
        for b in r.sample(range(128), r.randint(0, 60)):
            f[b // 64] ^= np.uint64(1 << b % 64)
        prints.append(f)
    prints = np.array(prints)
    near = {(i, k, d) for i, f in enumerate(prints) for k, d in enumerate(op5_leaks.distances(f, items.prints).tolist()) if d <= op5_leaks.RADIUS and items.words[k] == 20}
    assert {tuple(x) for x in zip(*(y.tolist() for y in items.within(np.full(len(prints), 20), prints)), strict=True)} == near and len(near) > 50


def test_blocks_pass_few_items():
    r = np.random.default_rng(5)
    items = packed_items([" ".join(f"w{x}" for x in r.integers(0, 10**6, 20)) for _ in range(400)])
    _, item = items.candidates(np.full(200, 20), r.integers(0, 2**63, (200, 2)).astype(np.uint64) * np.uint64(2) + np.uint64(1))
    assert len(item) / (200 * 400) < 0.05


def test_very_long_texts_are_searched_whole():
    r = random.Random(17)
    whole = [" ".join(f"q{r.randint(0, 10**6)}" for _ in range(n)) for n in (30, 30, 45, 2, 6000)]
    items, filler = packed_items(whole), " ".join(f"z{r.randint(0, 10**6)}" for _ in range(200_000))
    assert not items.matches(filler.encode())
    text = " ".join([filler, whole[1], whole[3], filler, whole[4], "tail"])
    assert [(k, s) for k, s, *_ in items.matches(text.encode())] == [(1, 200_000), (3, 200_030), (4, 400_032)]


def test_recall_at_the_threshold():
    """Items whose similarity with what a text holds lies over 0.75 and under 0.8 (words in no item weigh a little more)."""
    r = random.Random(11)
    say = lambda n: [f"q{r.randint(0, 10**6)}" for _ in range(n)]
    whole = [say(r.randint(30, 60)) for _ in range(150)]
    items, seen, hit = packed_items([" ".join(w) for w in whole]), 0, 0
    for i, w in enumerate(whole):
        cut = next(c for c in range(1, 20) if (len(w) - 4 - c) / (len(w) - 4 + c) < 0.8)
        sim = (len(w) - 4 - cut) / (len(w) - 4 + cut)
        if sim > 0.7501:
            text = " ".join(say(50) + w[:-cut] + say(50 + cut))
            seen, hit = seen + 1, hit + (i in {m[0] for m in items.matches(text.encode())})
    assert seen > 100 and hit / seen >= 0.97


# 7: lists


def test_intervals_and_hosts(spark):
    entries = spark.createDataFrame([("l", "Ex.org", None, "add", "2024-01-02"), ("l", "ex.org", "", "remove", "2024-01-05"), ("l", "ex.org", "", "add", "2024-01-05"), ("m", "a.ex.org", "/p", "add", "2024-01-01"), (None, "ex.org", "", "add", "2020-01-01"), ("l", None, "", "add", "2020-01-01"), ("l", "ex.org", "", "odd", "2020-01-01")], "list string, domain string, path string, action string, at string")
    urls = [("http://u:p@A.EX.org:80/p/q?x", "2024-01-03"), ("https://ex.org.", "2024-01-01"), ("https://ex.org", "2024-01-05"), ("https://notex.org/p", "2024-01-03"), ("ex.org/p", "2024-01-03"), (None, "2024-01-03"), ("http://a.ex.org/p", None), ("http://a.ex.org/P", "2024-01-04")]
    pages = spark.createDataFrame([(i, u, t, "mine") for i, (u, t) in enumerate(urls)], "page_id long, url string, fetched string, lists string")
    out = {r.page_id: (r.host, r.n_active, r.blocked, r.lists) for r in op7_urls.evaluate(pages, entries).collect()}
    assert out == {0: ("a.ex.org", 2, True, "l,m"), 1: ("ex.org", 0, False, None), 2: ("ex.org", 0, False, None), 3: ("notex.org", 0, False, None), 4: (None, 0, False, None), 5: (None, 0, False, None), 6: ("a.ex.org", 0, False, None), 7: ("a.ex.org", 1, True, "l")}
    assert op7_urls.evaluate(pages.limit(0), entries).count() == 0
    assert not any(r.blocked for r in op7_urls.evaluate(pages, entries.limit(0)).collect())


def test_hot_hosts_repeated_rows_and_clashing_names(spark, tmp_path):
    (tmp_path / "list.csv").write_text("list,domain,path,action,at\nl,hot.org,,add,2024-01-02\nm,hot.org,/p,add,2024-01-01\nm,hot.org,/p,remove,2024-02-01\nn,org,,add,2024-01-03\n")
    entries = op7_urls.read_list(spark, str(tmp_path / "list.csv"))
    rows = [(i % 900, f"http://hot.org/{'p' if i % 2 else 'q'}", f"2024-0{1 + i % 2}-04") for i in range(2500)] + [(i, f"http://h{i}.org/", "2024-01-02") for i in range(300)] + [(None, None, None)]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, fetched string, rules string, `on.row` int")
    out = op7_urls.evaluate(pages, entries)
    assert out.columns == ["page_id", "url", "fetched", "rules", "on.row", "host", "n_active", "blocked", "lists"]
    expected = [(i, 2, "l,n") for i, u, _ in rows if u and "hot" in u] + [(i, 0, None) for i, u, _ in rows if not u or "hot" not in u]
    assert sorted(((r.page_id, r.n_active, r.lists) for r in out.collect()), key=str) == sorted(expected, key=str)


# 8: licenses


def test_scan_awkward_rows(spark):
    more = [(50, "CC-BY and the MIT\nlicense; cc by", "", "", "", ""), (51, "under the LICENSED apache license version 2 0", "", "", "", "")]
    out = {r.doc_id: r for r in op8_licenses.scan(odd_docs(spark).union(spark.createDataFrame(more, DOC))).collect()}
    assert (out[0].n_words, out[0].n_base, out[0].first_word, out[0].base_labels, out[0].score) == (0, 0, None, "", 0.0)
    assert (out[50].n_words, out[50].n_base, out[50].first_word, out[50].last_word, out[50].labels) == (8, 3, 0, 6, "cc-by,mit")
    assert out[51].labels == "apache,apache-2.0" and out[51].score == 1.0
    assert op8_licenses.scan(odd_docs(spark).limit(0)).count() == 0


def test_filters_lose_no_block():
    r = random.Random(6)
    pool = [f"t{i}" for i in range(30)]
    templates = {str(k): " ".join(r.sample(pool, r.randint(2, 12))) for k in range(15)}
    m = op8_licenses.Matcher(templates, {w.encode(): r.randint(0, 9) for w in pool}, 0.7)
    for _ in range(500):
        block = {w.encode() for w in r.sample(pool, r.randint(0, 20))}
        expected = {(k, len(block & s) / len(s)) for k, t in templates.items() if len(block & (s := set(op8_licenses.words_of(t.encode())))) / len(s) >= 0.7}
        assert set(m.block(block)) == expected


def test_filters_reject_and_runs_are_those_of_brute_force():
    r = random.Random(16)
    pool = [f"t{i}" for i in range(40)]
    templates = {str(k): " ".join(r.choices(pool, k=r.randint(3, 14))) for k in range(12)}
    m = op8_licenses.Matcher(templates, {w.encode(): r.randint(0, 9) for w in pool}, 0.8)
    for _ in range(400):
        words = [w.encode() for w in r.choices(pool + [f"o{i}" for i in range(60)], k=r.randint(0, 60))]
        if r.random() < 0.7:
            t = r.choice(list(templates.values())).encode().split()
            words[len(words) // 2 : len(words) // 2] = [w if r.random() < 0.9 else b"odd" for w in t]
        expected = set()
        for k, t in templates.items():
            template, size = set(t.encode().split()), len(t.split())
            best = max((len(template.intersection(words[i : i + size])) for i in range(len(words))), default=0)
            if best >= 0.8 * len(template) - 1e-9:
                expected.add((k, best / len(template)))
        assert set(m.text(b"", words, set(words), False)) == expected
    assert m.rejected["length"] > 20 and m.rejected["position"] > 100


def test_whole_license_texts_from_a_table(spark):
    text = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    rows = [("isc", text), ("isc", "zz later"), (None, "x"), ("none", None), ("empty", "")]
    templates = op8_licenses.template_table(spark.createDataFrame(rows, "label string, text string"))
    assert templates == {"isc": text, "empty": ""}
    docs = spark.createDataFrame([(1, "Copyright X\n\n * " + text.upper().replace(", ", ",\n * ") + " THE END " * 9000, "", "", "", ""), (2, text[:60], "", "", "", ""), (2, None, "", "", "", "")], DOC)
    assert [(r.doc_id, r.labels) for r in op8_licenses.scan(docs, templates=templates).orderBy("doc_id").collect()] == [(1, "isc"), (2, ""), (2, "")]
    with pytest.raises(ValueError, match="bytes"):
        op8_licenses.template_table(spark.createDataFrame(rows, "label string, text string"), most_bytes=100)


def test_wrapped_notices_are_found(spark):
    wrapped = [
        ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal"),
        ("bsd", " * Redistribution and use in source and binary forms, with or without\r\n * modification, are permitted provided that the following conditions\r\n * are met:"),
        ("mpl-2.0", "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this"),
    ]
    filler = "some words of a page\n" * 50
    docs = [(i, filler + t + "\n" + filler, "", "", "", "") for i, (_, t) in enumerate(wrapped)]
    scattered = "\n".join(w + " and some other words that stand between" for w in op8_licenses.TEMPLATES["mpl-2.0"].split())
    out = {r.doc_id: r for r in op8_licenses.scan(spark.createDataFrame([*docs, (9, scattered, "", "", "", "")], DOC)).collect()}
    assert [(out[i].labels, out[i].score) for i in range(3)] == [(label, 1.0) for label, _ in wrapped]
    assert (out[9].labels, out[9].score) == ("", 0.0)


def test_licenses_of_like_wording_are_told_apart(spark):
    texts = {
        "Licensed under CC BY-NC 4.0.": ("cc-by", "cc-by-nc-4.0"),
        "Licensed under\nCC BY-SA 4.0.": ("cc-by", "cc-by-sa-4.0"),
        "Licensed under CC BY 4.0.": ("cc-by",),
        "Licensed under CC BY-NC-SA 4.0.": ("cc-by",),
        "Licensed under CC BY-NC 3.0.": ("cc-by",),
        "Released under the Apache License, Version 2.0.": ("apache", "apache-2.0"),
        "Released under the MIT License.": ("mit", "mit-notice"),
        "This work is licensed under the GNU General Public License, version 2.": ("gpl",),
        " and ".join(["the old mit on a hill was released", *["words"] * 40, "under this license"]): (),
    }
    docs = spark.createDataFrame([(i, t, "", "", "", "") for i, t in enumerate(texts)], DOC)
    out = {r.doc_id: r.labels for r in op8_licenses.scan(docs).collect()}
    assert [out[i] for i in range(len(texts))] == [",".join(x) for x in texts.values()]
    assert all(set(p.split()) <= {w.decode() for w in op8_licenses.words_of(op8_licenses.TEMPLATES[k].encode())} for k, ps in op8_licenses.TELLING.items() for p in ps)
    # wrapped, the query tells them apart too; in one line it follows its SQL
    query = {r.doc_id: r.labels for r in op8_licenses.scan(docs, any_in_lines=True).collect()}
    assert query[1] == "cc-by,cc-by-sa-4.0"


def test_runs_of_words_are_those_of_brute_force():
    r = random.Random(8)
    for _ in range(500):
        words = [b"%d" % r.randint(0, 15) for _ in range(r.randint(0, 40))]
        template, size = frozenset(b"%d" % x for x in r.sample(range(16), 5)), r.randint(1, 12)
        expected = max((len(template.intersection(words[i : i + size])) for i in range(len(words))), default=0)
        assert op8_licenses.most_in_run(words, template, size) == expected
        telling = [r.sample(sorted(template), r.randint(1, 2)) for _ in range(r.randint(1, 2))]
        runs = [words[i : i + size] for i in range(len(words)) if all(op8_licenses.places(words[i : i + size], p) for p in telling)]
        assert op8_licenses.most_in_run(words, template, size, telling) == max((len(template.intersection(x)) for x in runs), default=0)


# 9: near duplicates


def brute_components(docs):
    def grams(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    sets = [grams(t) for _, t in docs]
    comp = [float("inf") if d is None else d for d, _ in docs]
    changed = True
    links = [(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets[:i]) if x and y and 100 * len(x & y) >= 75 * len(x | y)]
    while changed:
        changed = False
        for a, b in links:
            low = min(comp[a], comp[b])
            changed |= comp[a] != low or comp[b] != low
            comp[a] = comp[b] = low
    return sorted(((d, len(s), None if c == float("inf") else c) for (d, _), s, c in zip(docs, sets, comp, strict=True)), key=str)


def rows_by_doc(out):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=str)


def near_docs():
    """Chains of edits, a large cluster, copies, short texts and unrelated texts that share a long passage."""
    r = random.Random(9)
    vocab = [f"v{i}" for i in range(4000)]
    say = lambda n: [r.choice(vocab) for _ in range(n)]
    docs, passage = [], say(40)
    for _ in range(30):
        w = say(r.randint(20, 200))
        for _ in range(r.randint(1, 4)):
            docs.append(" ".join(w))
            w = w[:]
            for _ in range(r.randint(0, 1 + len(w) // 60)):
                w[r.randrange(len(w))] = r.choice(vocab)
            if r.random() < 0.3:
                w = w[: -r.randint(1, 5)] + say(2)
    base = say(120)
    for _ in range(70):
        w = base[:]
        for _ in range(r.randint(0, 3)):
            w[r.randrange(120)] = r.choice(vocab)
        docs.append(" ".join(w))
    docs += [" ".join(say(30) + passage + say(30)) for _ in range(60)] + [" ".join(passage + say(k)) for k in range(12)]
    docs += [" ".join(say(3)[:k]) for k in (1, 2, 3)] * 2 + ["a b c d e f g", "A b c d e f g", "a b c d e f", "a b c d e f g h", "a b c d e", "x " * 50, "x " * 60, "x", "", " "]
    # rows without id: a copy, a bridge between two texts that don't link, a pair by themselves
    left, lone = say(60), say(50)
    right = ["r"] * 0 + left[12:] + say(12)
    docs += [" ".join(left), " ".join(right)]
    none = ["a b c d e f g", " ".join(left[6:] + right[48:54]), " ".join(lone), " ".join(lone + ["tail"]), None, ""]
    return list(enumerate(docs)) + [(900, None)] + [(None, t) for t in none]


def test_components_are_those_of_brute_force(spark):
    docs = near_docs()
    df = spark.createDataFrame([(*x, "z", 1) for x in docs], "doc_id long, text string, digest string, n long")
    out = op9_jaccard.join(df).collect()
    assert rows_by_doc(out) == brute_components(docs)
    assert sum(r.doc_id is None and r.component_id is not None for r in out) == 2
    twice = op9_jaccard.join(df.union(df)).collect()
    assert len(twice) == 2 * len(docs) and set(twice) == set(out)
    assert op9_jaccard.join(df.limit(0)).count() == 0


@pytest.mark.parametrize("small", [op9_jaccard.SMALL, 2])
def test_texts_of_one_id_are_linked_each_by_itself(spark, monkeypatch, small):
    monkeypatch.setattr(op9_jaccard, "SMALL", small)
    r = random.Random(12)
    docs, expected = [], {}
    for k in range(20):  # id k has two texts; both have a near copy, one of a smaller id and one of a larger
        a, b = ([f"{x}{k}w{r.randint(0, 5000)}" for _ in range(60)] for x in "ab")
        for i, w, c in [(1000 + k, a, k), (k, a + ["tail"], k), (1000 + k, b, 1000 + k), (2000 + k, b + ["tail"], 1000 + k)]:
            docs.append((i, " ".join(w)))
            expected[i, len(w) - 4] = expected.get((i, len(w) - 4), []) + [c]
    out = defaultdict(list)
    for x in op9_jaccard.join(spark.createDataFrame(docs, "doc_id long, text string").repartition(8)).collect():
        out[x.doc_id, x.n_shingles].append(x.component_id)
    assert {k: sorted(v) for k, v in out.items()} == {k: sorted(v) for k, v in expected.items()}


@pytest.mark.parametrize("budget", [-1, 40, op9_jaccard.BUDGET, 10**6])  # -1: no thresholds are taken at all
def test_the_last_comparison_alone_finds_hidden_links(spark, monkeypatch, budget):
    monkeypatch.setattr(op9_jaccard, "BUDGET", budget)
    monkeypatch.setattr(op9_jaccard, "SMALL", 2)
    monkeypatch.setattr(op9_jaccard, "BLOCK", 20)
    docs = near_docs()
    out = op9_jaccard.join(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert rows_by_doc(out) == brute_components(docs)


def test_unlike_texts_of_one_id_and_very_long_ones(spark):
    r = random.Random(21)
    say = lambda n: [f"u{r.randint(0, 9000)}" for _ in range(n)]
    long, a, b = say(60_000), say(50), say(50)
    docs = [(1, a), (1, b), (2, b + ["tail"]), (3, a + ["tail"]), (4, long), (5, long[:59_000] + say(500)), (None, long + say(40)), (6, say(30_000))]
    docs = [(i, " ".join(w)) for i, w in docs] + [(7, "x" * 300_000), (7, "x" * 300_000)]
    out = op9_jaccard.join(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert rows_by_doc(out) == brute_components(docs)


def test_pigeonhole_holds_for_random_sets():
    r = np.random.default_rng(8)
    for _ in range(400):
        n = int(r.integers(1, 60))
        a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        drop, add = int(r.integers(0, 1 + len(a) // 4)), int(r.integers(0, 1 + len(a) // 4))
        b = np.unique(np.r_[r.permutation(a)[drop:], r.integers(0, 2**63, add).astype(np.uint64)])
        if sh.linked(a, b):
            x, y = op9_jaccard.Indexed(a), op9_jaccard.Indexed(b)
            low = op9_jaccard.band_of(min(len(a), len(b)))
            pick = lambda i, s: i.by_role[0 if op9_jaccard.band_of(len(s)) == low else 1]
            shared = len(np.intersect1d(pick(x, a), pick(y, b)))
            role = 0 if op9_jaccard.band_of(len(a)) == low else 1
            assert shared >= x.segments[role] - (len(a) + len(b)) // 7
            if min(len(a), len(b)) <= op9_jaccard.SHORT:
                every = [np.concatenate(list(i.by_role.values())) for i in (x, y)]
                assert len(np.intersect1d(*every)) >= 1


def test_any_thresholds_that_suffice_find_a_linked_set():
    r = np.random.default_rng(5)
    seen = Counter()
    for _ in range(600):
        a = np.unique(r.integers(0, 2**63, int(r.integers(1, 90))).astype(np.uint64))
        drop, add = int(r.integers(0, 1 + len(a) // 4)), int(r.integers(0, 1 + len(a) // 4))
        b = np.unique(np.r_[r.permutation(a)[drop:], r.integers(0, 2**63, add).astype(np.uint64)])
        if not sh.linked(a, b):
            continue
        band = op9_jaccard.band_of(min(len(a), len(b)))
        for x, y in ((a, b), (b, a)):
            role = 0 if op9_jaccard.band_of(len(x)) == band else 1
            seg, kind, sig = op9_jaccard.offers(x, band)
            most = {int(k): int(kind[seg == k].max()) for k in seg}
            steps = [(k, t) for k in r.permutation(list(most)) for t in range(most[int(k)] + 1)]
            need = op9_jaccard.needs(len(x), role)
            if len(steps) < need:
                seen["too few"] += 1
                continue
            level = {int(k): t for k, t in steps[:need]}
            _, other_kind, other_sig = op9_jaccard.offers(y, band)
            whole, less = set(other_sig[other_kind == 0].tolist()), set(other_sig[other_kind == 1].tolist())
            hit = False
            for k, t, v in zip(seg.tolist(), kind.tolist(), sig.tolist(), strict=True):
                if t <= level.get(k, -1):
                    hit = hit or v in whole or (level[k] == 1 and t == 0 and v in less)
            assert hit
            seen["found"] += 1
    assert seen["found"] > 200


@pytest.mark.parametrize("budget", [3, 60, 10**6])
def test_documents_with_thresholds_find_every_link_by_them(spark, monkeypatch, budget):
    monkeypatch.setattr(op9_jaccard, "BUDGET", budget)
    sets = {}
    for i, text in near_docs():
        s = sh.shingle_set((text or "").encode())
        if len(s):
            sets.setdefault(op9_jaccard._digest(s)[1], s)
    keys = sorted(sets)
    table = spark.createDataFrame([(k, sets[k].view(np.int64).tolist()) for k in keys], "key long, set array<long>")
    deficient = spark.createDataFrame([(k, k, k) for k in keys], "id long, key long, comp long")
    links, rest, _ = op9_jaccard._allocated(deficient, table)
    got = {(x.a.key, x.b.key) for x in links.collect()}
    left = {x.key for x in rest.collect()}
    true = {(a, b) for a in keys for b in keys if a < b and sh.linked(sets[a], sets[b])}
    assert got <= true and {(a, b) for a, b in true if a not in left or b not in left} <= got
    assert not left if budget == 10**6 else len(left) < len(keys)


def test_buckets_fill_partitions_evenly(spark):
    for partitions, buckets in ((7, 7), (5, 12), (3, 300)):
        names = op9_jaccard._names(spark, partitions, buckets)
        at = spark.createDataFrame([(int(x),) for x in names], "b int").select(F.pmod(F.hash("b"), F.lit(partitions)).alias("p")).groupBy("p").count().collect()
        assert len(set(names.tolist())) == buckets and max(r["count"] for r in at) <= max(-(-buckets // partitions), 130 if buckets == 300 else 0)


def test_components_of_chains_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100), (None, 3), (201, 200), (202, 201), (200, 202)]
    out = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {i: 0 for i in range(41)} | {200: 200, 201: 200, 202: 200}


# 10: mixing


def test_mix_reaches_targets(spark):
    r = random.Random(3)
    rows = [(i, "w " * r.randint(0, 40), r.choice(["a", "b", "b", "b", "c", "d", None])) for i in range(3000)] + [(9000, None, "a"), (9001, "x y", "only"), (None, "no id", "b")]
    df = spark.createDataFrame([(*x, "t") for x in rows], "doc_id long, text string, source string, target string")
    out = op10_mix.mix(df).collect()
    assert len(out) == len(rows) and all(0 <= x.taken <= 3 * x.size for x in out)
    assert sorted(out, key=str) == sorted(op10_mix.mix(df).collect(), key=str)
    taken, target, size = defaultdict(int), {}, {}
    for x in out:
        taken[x.source] += x.taken
        target[x.source], size[x.source] = x.target, x.source_size
    assert abs(sum(target.values()) - sum(size.values())) < 1e-6
    for s in target:
        assert target[s] <= 3 * size[s] + 1e-9 and abs(taken[s] - target[s]) <= 40
    copies = op10_mix.apply_mix(df).groupBy("doc_id", "source").count().collect()
    by_id = {(x.doc_id, x.source): x.taken // x.size for x in out if x.size}
    assert {k: n for k, n in by_id.items() if n} == {(c.doc_id, c["source"]): c["count"] for c in copies if (c.doc_id, c["source"]) in by_id}
    assert op10_mix.apply_mix(df).columns == df.columns
    assert op10_mix.mix(df.limit(0)).count() == 0


def test_a_larger_budget_keeps_all_of_a_smaller_one(spark):
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.pmod("id", F.lit(3)).cast("string").alias("source"))
    some, more = ({r.doc_id for r in op10_mix.mix(df, share=s).where("taken > 0").collect()} for s in (0.2, 0.4))
    assert some < more


def test_mix_splits_rows_of_one_hash(spark):
    """Repeated ids and rows, and null ids: each source comes within a document of its target."""
    rows = [(1, "a b c", "one") for _ in range(100)] + [(None, f"n{i} b c d", "none") for i in range(100)] + [(None, None, "none"), (None, "", "none")]
    rows += [(i % 7, f"x{i} y", "few") for i in range(500)] + [(5000 + i, "long " * (40_000 if i == 3 else 3), "rest") for i in range(200)]
    df = spark.createDataFrame([(*x, 1, 2.0) for x in rows], "doc_id long, text string, source string, h long, `row.x` double").repartition(5)
    out = op10_mix.mix(df).collect()
    taken, target = defaultdict(int), {}
    for x in out:
        taken[x.source] += x.taken
        target[x.source] = x.target
        assert x.taken in (0, x.size, 2 * x.size, 3 * x.size)
    assert len(out) == len(rows) and len(set(target.values())) > 1
    assert all(abs(taken[s] - target[s]) <= (40_000 if s == "rest" else 4) for s in target)
    assert abs(taken["one"] - target["one"]) <= 1.5
    mixed = op10_mix.apply_mix(df)
    assert mixed.columns == df.columns
    words = {r.source: r.n for r in mixed.groupBy("source").agg(F.sum(op10_mix.size_of(F.col("text"))).alias("n")).collect()}
    assert words == {s: n for s, n in taken.items() if n}
    assert sorted(out, key=str) == sorted(op10_mix.mix(df).collect(), key=str)


def test_mix_of_repeated_rows_is_that_of_its_sql(spark, tmp_path):
    import duckdb

    df = spark.createDataFrame([(i % 3, "a b", "s") for i in range(50)] + [(None, "c " * (i % 4), None) for i in range(30)] + [(9, None, "t"), (9, "d", "t")], "doc_id long, text string, source string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert rows_of(op10_mix.query(spark, str(tmp_path))) == duck_rows(c, op10_mix.SQL)


def test_hot_keys_are_joined_by_broadcast(spark):
    left = spark.createDataFrame([(7, i) for i in range(3000)] + [(i % 50, i) for i in range(2000)] + [(None, 1)], "k long, x long")
    right = spark.createDataFrame([(i, i * 10) for i in range(0, 50, 7)], "k long, y long")
    for how in ("inner", "left"):
        assert sorted(common.spread_join(left, right, "k", how).collect(), key=str) == sorted(left.join(right, "k", how).collect(), key=str)
    packed = lambda df: df.withColumn("k", F.struct(F.col("k").alias("id"), F.lit(None).cast("string").alias("name"), F.lit("x").alias("z")))
    a, b = packed(left.where("k is not null")), packed(right)
    out = common.spread_join(a, b, "k")
    assert out.count() == a.join(b, "k").count() and "Python" not in out._jdf.queryExecution().toString()


def test_sweep_removes_what_is_left(spark, tmp_path):
    t = common.written(spark.range(5), "left")
    assert t.count() == 5 and common.sweep(spark) >= 1 and common.sweep(spark) == 0
    assert not __import__("os").path.exists(t._stored_at)


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    def session(master, top=None):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: "set")
        return SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: top), sparkContext=context)

    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            common.shared_dir(session(master))
    assert common.shared_dir(session("yarn", "hdfs://x/y/")) == "hdfs://x/y" and common.shared_dir(session("local[4]")).startswith("/tmp")
