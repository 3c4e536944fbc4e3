"""The pipeline's stages on a small corpus: each decision takes effect on what came before."""

import glob
import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from sylvan.llm import bpe, common
from tests.llm.test_operators import brute_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    r = random.Random(5)
    vocab = [f"v{i}" for i in range(3000)]
    say = lambda n: [r.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(say(25))) for i in range(5)]
    docs, toxic = [], set()
    for i in range(400):
        w = say(r.randint(30, 90))
        if i % 8 == 0:
            toxic.add(i)
            for _ in range(4):
                w.insert(r.randrange(len(w)), r.choice(["idiot", "moron", "scum"]))
        if i % 50 == 7:
            w[5:5] = items[i % 5][1].split()
        docs.append((i, " ".join(w), "en", f"s{i % 3}", 0))
    docs += [(1000 + k, docs[k][1] + " tail", "en", "s0", 0) for k in (1, 2, 3)] + [(2000, None, None, None, None), (1, docs[1][1], "en", "s1", 0)]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, docs, toxic


def test_stages(spark, corpus):
    d, docs, toxic = corpus
    frames = [spark.read.parquet(f"{d}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        frames.append(common.written(stage(spark, frames[-1], d), f"test-{name}"))
    kept = [[r.doc_id for r in f.select("doc_id").collect()] for f in frames]
    assert set(kept[0]) - set(kept[1]) == toxic  # the rest stays
    groups = brute_components([(x, t) for x, t, *_ in docs if x not in toxic])
    assert sorted(kept[2]) == sorted({c for _, _, c in groups})
    assert set(kept[2]) - set(kept[3]) == {i for i in kept[2] if i % 50 == 7 and i < 1000}
    assert set(kept[4]) <= set(kept[3]) and max(map(kept[4].count, kept[4])) <= 3
    assert all(f.columns == frames[0].columns for f in frames[:-1])
    library = bpe.library(common.tokenizer_path("word_bpe_49k.json"))
    text = {r.doc_id: r.text or "" for r in frames[4].collect()}
    at = 0
    for r in frames[5].orderBy("start").collect():
        ids = np.array(library.encode(text[r.doc_id], add_special_tokens=False).ids + [1], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert frames[5].count() == len(kept[4])


def test_run_gives_the_last_stage(spark, corpus):
    assert corpus_pipeline.run(spark, corpus[0]).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_empty_documents(spark, corpus):
    docs = spark.read.parquet(f"{corpus[0]}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, corpus[0])
        assert docs.count() == 0


def test_other_texts_of_an_id_stay(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    e, f = (" ".join(f"{x}{i}" for i in range(60)) for x in "ef")
    rows = [(1, a), (5, a + " tail"), (5, b), (5, b), (5, c), (9, b + " tail"), (5, ""), (7, d), (7, d + " tail"), (1, None)]
    rows += [(None, a), (None, e), (None, e), (None, e + " tail"), (None, f), (12, f + " tail"), (None, None), (20, "long " * 30_000)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, t) for i, t in rows], SCHEMA + ", `key.root` string")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    kept = [(x.doc_id, (x.text or "").removesuffix(" tail")) for x in out.collect()]
    assert sorted(kept, key=str) == sorted([(1, a), (1, ""), (5, b), (5, c), (5, ""), (7, d), (None, e), (12, f), (None, ""), (20, "long " * 30_000)], key=str)
    assert out.columns == docs.columns


def test_small_tables_have_few_files(spark, corpus, monkeypatch):
    """However many partitions a shuffle has, tables of a few rows are not written as that many files."""
    few, files, written = 2 * spark.sparkContext.defaultParallelism, {}, common.written

    def counted(df, name, *a, **b):
        out = written(df, name, *a, **b)
        files[name] = max(files.get(name, 0), len(glob.glob(f"{out._stored_at.removeprefix('file:')}/**/part-*", recursive=True)))
        return out

    conf = {"spark.sql.shuffle.partitions": str(4 * few), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    monkeypatch.setattr(common, "written", counted)
    try:
        docs = spark.read.parquet(f"{corpus[0]}/documents.parquet")
        kept = [r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, corpus[0]).collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    groups = brute_components([(x, t) for x, t, *_ in corpus[1]])
    assert sorted(kept) == sorted({c for _, _, c in groups})
    assert files.pop("op9-found") > few  # texts are shingled and compared there: as many tasks as the shuffle has
    assert {"op9-classes", "op9-pairs", "op9-edges", "edges", "labels", "groups", "duplicates"} <= set(files)
    assert all(n <= few for n in files.values()), files


def test_files_follow_rows(spark):
    count = lambda t: len(glob.glob(f"{t._stored_at.removeprefix('file:')}/part-*"))
    df = spark.range(0, 5000, 1, 100)
    for rows, file_rows, files in ((None, 10, 100), (5000, 100, 50), (5000, 10, 100), (5000, 5000, 2 * spark.sparkContext.defaultParallelism)):
        t = common.written(df, "files", rows, file_rows)
        assert count(t) == files and sorted(r.id for r in t.collect()) == list(range(5000))


def test_workers_give_memory_back(spark):
    def held() -> int:
        with open("/proc/self/smaps_rollup") as f:
            return next(int(x.split()[1]) for x in f if x.startswith("Pss_Anon"))

    def run(batches):
        for b in batches:
            before = held()
            pieces = [bytes(1000) for _ in range(100_000)]
            last = bytes(1000)  # stands above the pieces, so that freeing them doesn't shrink the heap
            del pieces
            yield b
        assert held() - before > 50_000 and last, "what was freed is still held"
        spent.append(before)

    spent: list[int] = []
    for _ in common.lean(run)([None]):
        pass
    assert held() - spent[0] < 30_000
