from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from conftest import rows

from lodestone.operators import batch
from lodestone.plans import search
from test_search import CORPUS, EXPECTED

WORDS = [f"w{i:02d}" for i in range(40)]


def texts_of(n: int, seed: int) -> list[str]:
    rng = np.random.default_rng(seed)
    p = 1 / np.arange(1, len(WORDS) + 1)
    return [" ".join(rng.choice(WORDS, rng.integers(1, 30), p=p / p.sum())) for _ in range(n)]


def brute(docs: list[list[str]], asked: list[list[str]], k: int, every: bool) -> list[list[tuple]]:
    n, avgdl = len(docs), sum(map(len, docs)) / len(docs)
    df = {t: sum(t in d for d in docs) for t in WORDS}
    idf = {t: np.log((n - df[t] + 0.5) / (df[t] + 0.5)) for t in WORDS}
    out = []
    for q in asked:
        hits = []
        for i, d in enumerate(docs):
            own = [t for t in q if t in d]
            if own and (not every or len(own) == len([t for t in q if df[t]])):
                s = 0.0
                for t in own:
                    s += idf[t] * ((d.count(t) * (1.2 + 1.0)) / (d.count(t) + 1.2 * ((1.0 - 0.75) + 0.75 * len(d) / avgdl)))
                hits.append((-s, i))
        out.append([(i, -s) for s, i in sorted(hits)[:k]])
    return out


@pytest.mark.parametrize("every", [False, True])
@pytest.mark.parametrize(("k", "size", "long"), [(3, 1 << 15, 1000), (3, 70, 1000), (3, 500, 0), (400, 70, 1000)])
def test_best_of_streams_equals_brute_force(monkeypatch, k, size, long, every):
    monkeypatch.setattr(batch, "DOCS", size)
    monkeypatch.setattr(batch, "LONG", long)
    monkeypatch.setattr(batch, "BLOCK", 7)
    docs = [t.split() for t in texts_of(300, 1) + texts_of(20, 1)]  # 20 equal texts: ties
    asked = [sorted(set(t.split())) for t in texts_of(30, 2)] + [["w00"], ["w00", "w01"], ["w39"]]
    n = len(docs)
    df = np.array([sum(t in d for d in docs) for t in WORDS])
    ptr = np.r_[0, np.cumsum([len(q) for q in asked])]
    q = batch.Queries(pa.array(WORDS), np.log((n - df + 0.5) / (df + 0.5)), df / n, ptr, np.array([WORDS.index(t) for a in asked for t in a]), sum(map(len, docs)) / n, k, 1.2, 0.75, every)
    assert (q.slot >= 0).any() and (q.slot < 0).any()
    streams = [pa.record_batch({"doc_id": range(s, min(n, s + 90)), "length": [len(d) for d in docs[s : s + 90]], "terms": docs[s : s + 90]}) for s in range(0, n, 90)]
    best = batch.best_of(q, iter(streams))
    got = [[(int(d), float(s)) for d, s in zip(best.doc[i, :h], best.score[i, :h])] for i, h in enumerate(best.held)]
    assert got == brute(docs, asked, k, every)


@pytest.mark.parametrize("mode", ["or", "and"])
@pytest.mark.parametrize("saved", [False, True])
def test_streamed_batch_equals_single_searches(spark, tmp_path, monkeypatch, mode, saved):
    monkeypatch.setattr(search, "JOINED", -1)
    monkeypatch.setattr(search, "PART_TERMS", 3)
    engine = search.SearchEngine.from_passages(spark.createDataFrame(CORPUS, "doc_id bigint, passage_id string, text string"))
    if saved:
        engine.save(str(tmp_path / "i"))
        engine = search.SearchEngine.load(spark, str(tmp_path / "i"))
    asked = sorted({q for q, m in EXPECTED if m == mode})
    got: dict = {}
    for r in engine.search_batch(spark.createDataFrame([(q, q) for q in asked], "query_id string, text string"), mode, 2).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["doc_id"], r["score"] + 0.0))
    assert got == {q: EXPECTED[q, mode][:2] for q in asked if EXPECTED[q, mode]}


def test_whole_texts_as_queries_are_not_shuffled_as_pairs(spark):
    """150 queries match nearly all of 3,000 passages by several terms each, which a join shuffles as 20 MB."""
    texts = texts_of(3000, 3)
    passages = spark.createDataFrame([(i, str(i), t) for i, t in enumerate(texts)], "doc_id bigint, passage_id string, text string")
    folders = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs())
    used = lambda: {str(p): p.stat().st_size for f in folders for p in Path(f.getPath()).rglob("shuffle_*.data") if p.exists()}
    before = used()
    engine = search.SearchEngine.from_passages(passages)
    got = rows(engine.search_batch(passages.where("doc_id % 20 = 0").selectExpr("doc_id AS query_id", "text"), "or", 5))
    assert sum(n for p, n in used().items() if p not in before) < 3e6
    assert len(got) == 750
    for q in (0, 2980):
        want = engine.search(texts[q], "or", 5).orderBy("rank").collect()
        assert [r[2:] for r in got if r[0] == q] == [(r["doc_id"], r["score"]) for r in want]
