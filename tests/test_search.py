import pytest
from conftest import rows

from lodestone.operators import index
from lodestone.plans import cli, search, snippets
from lodestone.sources import collection as src
from lodestone.streaming import append

CORPUS = [(0, "p0", "The cat sat"), (1, "p1", "the dog sat on the mat"), (2, "p2", "cats and dogs"), (3, "p3", "A !"), (4, "p4", "the the the"), (5, "p5", None)]
EXPECTED = {
    ("cat the", "or"): [(0, 0.0), (1, -0.996821), (4, -1.391086)],
    ("cat the", "and"): [(0, 0.0)],
    ("sat the", "or"): [(0, -0.9228), (1, -0.996821), (4, -1.391086)],
    ("sat the", "and"): [(0, -0.9228), (1, -0.996821)],
    ("dog sat", "or"): [(1, 0.680312), (0, 0.0)],
    ("dog sat", "and"): [(1, 0.680312)],
    ("dog zzqqxx", "and"): [(1, 0.680312)],
    ("zzqqxx", "or"): [],
    ("zzqqxx", "and"): [],
    ("", "or"): [],
    ("the the cat", "or"): [(0, 0.0), (1, -0.996821), (4, -1.391086)],
}


@pytest.fixture(scope="module")
def passages(spark):
    return spark.createDataFrame(CORPUS, "doc_id bigint, passage_id string, text string").cache()


@pytest.fixture(scope="module")
def engine(passages):
    return search.SearchEngine.from_passages(passages)


def hits(df):
    return [(r["doc_id"], r["score"] + 0.0) for r in df.orderBy("rank").collect()]


@pytest.mark.parametrize(("query", "mode"), list(EXPECTED))
def test_hand_computed_scores(engine, query, mode):
    assert hits(engine.search(query, mode, 10)) == EXPECTED[query, mode]


def test_batch_equals_single_searches(spark, engine):
    queries = sorted({q for q, _ in EXPECTED})
    df = spark.createDataFrame(list(enumerate(queries)), "query_id bigint, text string")
    for mode in ("or", "and"):
        got = {}
        for r in engine.search_batch(df, mode, 2).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["doc_id"], r["score"] + 0.0))
        assert got == {i: EXPECTED[q, mode][:2] for i, q in enumerate(queries) if EXPECTED.get((q, mode)) or (q, mode) in EXPECTED and EXPECTED[q, mode]} | {
            i: hits(engine.search(q, mode, 2)) for i, q in enumerate(queries) if (q, mode) not in EXPECTED and hits(engine.search(q, mode, 2))
        }


def test_intersection_keeps_shared_documents(spark):
    p = spark.createDataFrame([(5, "a", "aa"), (8, "b", "aa bb"), (9, "c", "bb")], "doc_id bigint, passage_id string, text string")
    assert [d for d, _ in hits(search.SearchEngine.from_passages(p).search("aa bb", "and"))] == [8]


def test_ties_go_by_doc_id(spark):
    p = spark.createDataFrame([(2, "a", "xx yy xx"), (0, "b", "xx yy zz"), (1, "c", "xx yy zz")], "doc_id bigint, passage_id string, text string")
    assert [d for d, _ in hits(search.SearchEngine.from_passages(p).search("zz", "or", 2))] == [0, 1]


@pytest.mark.parametrize("k", [0, -1])
def test_k_must_be_positive(engine, k):
    with pytest.raises(ValueError):
        engine.search("cat", k=k)


def test_unknown_mode(engine):
    with pytest.raises(ValueError):
        engine.search("cat", "xor")


def test_empty_collection(spark, passages):
    none = search.SearchEngine.from_passages(passages.where("false"))
    assert hits(none.search("cat")) == [] and none.stats() == (0, 0.0)


def test_index_tables(passages):
    post = index.postings(passages)
    assert rows(index.doc_table(passages)) == [(0, "p0", 3), (1, "p1", 6), (2, "p2", 3), (4, "p4", 3)]
    assert ("the", 4, 3) in rows(post) and sum(r[2] for r in rows(post)) == 15
    assert sum(r[1] for r in rows(index.lexicon(post))) == post.count()
    assert rows(index.delta_postings(post.where("term = 'the'"))) == [("the", 0, 0, 1), ("the", 1, 1, 2), ("the", 4, 3, 3)]
    layout = {r["term"]: r for r in index.lexicon_layout(post).collect()}
    assert layout["the"]["length"] == 18
    at = 0
    for t in sorted(layout):
        assert layout[t]["offset"] == at
        at += layout[t]["length"]


def test_gaps_across_ranges(spark):
    ids = [3, 65_535, 65_536, 65_540, 300_000]
    post = spark.createDataFrame([("t", i, 1) for i in ids], "term string, doc_id bigint, tf bigint")
    assert [r[2] for r in rows(index.delta_postings(post))] == [3, 65_532, 1, 4, 234_460]
    assert rows(index.unpacked_postings(index.packed_postings(post))) == rows(post)


def test_cursor(spark):
    post = spark.createDataFrame([("t", 2, 1), ("t", 5, 4), ("t", 9, 1)], "term string, doc_id bigint, tf bigint")
    assert rows(index.seek(post, "t", 3)) == [(5, 4)] and rows(index.seek(post, "t", 5)) == [(5, 4)] and rows(index.seek(post, "t", 10)) == []
    assert rows(index.next_doc(post, "t", 5)) == [(9, 1)]


def test_blocks(spark, passages, tmp_path):
    assert rows(index.block_stats(passages, 4)) == [(0, 4, 3), (1, 4, 4), (2, 4, 4)]
    with pytest.raises(ValueError):
        index.block_stats(passages, 0)
    index.write_blocks(passages, str(tmp_path / "blocks"), 4)
    back = spark.read.text(str(tmp_path / "blocks")).selectExpr("block_no", "split(value, '\t')[0] AS term", "0 AS piece_no", "split(value, '\t')[1] AS postings")
    assert rows(index.merge_blocks(back)) == rows(index.postings(passages))


def test_saved_index(spark, engine, passages, tmp_path):
    path = str(tmp_path / "index")
    search.SearchEngine.from_passages(passages.where("doc_id < 2")).save(path)
    engine.save(path)
    assert hits(search.SearchEngine.load(spark, path).search("cat the")) == EXPECTED["cat the", "or"]
    plan = spark.read.parquet(f"{path}/postings").where("term = 'cat'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,cat)" in plan


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "c.tsv").write_text("p0\tThe cat sat\np1\tthe dog sat on the mat\n", encoding="utf-8")
    assert cli.main(["index", str(tmp_path / "c.tsv"), str(tmp_path / "i")], spark) == 0
    assert cli.main(["search", str(tmp_path / "i"), "cat", "--source", str(tmp_path / "c.tsv")], spark) == 0
    assert "<b>cat</b>" in capsys.readouterr().out
    cli.main(["search", str(tmp_path / "i"), "zzz"], spark)
    assert "No Results" in capsys.readouterr().out


def test_blocks_and_merge_on_the_command_line(spark, tmp_path, capsys, monkeypatch):
    import io

    (tmp_path / "c.tsv").write_text("p0\tThe cat sat\np1\tthe dog sat on the mat\np2\tcats and dogs\n", encoding="utf-8")
    assert cli.main(["blocks", str(tmp_path / "c.tsv"), str(tmp_path / "b"), "--max-postings", "4"], spark) == 0
    assert cli.main(["merge", str(tmp_path / "b"), str(tmp_path / "c.tsv"), str(tmp_path / "i")], spark) == 0
    assert {r["block_no"] for r in src.read_block_files(spark, str(tmp_path / "b")).collect()} == {0, 1, 2}
    monkeypatch.setattr("sys.stdin", io.StringIO("sat the\n/k 1\n/mode and\nsat the\n/what\n\nnever read\n"))
    assert cli.main(["search", str(tmp_path / "i"), "--interactive"], spark) == 0
    out = capsys.readouterr().out
    assert "2 of 2 results" in out and "1 of 2 results" in out and "unknown command" in out and "No Results" not in out
    about = spark.read.json(str(tmp_path / "i/stats")).first()
    assert about["n_docs"] == 3 and about["created"] and about["format"] == search.FORMAT


def test_total_hits_and_lookup(spark, engine, passages):
    assert engine.total_hits("cat the") == 3 and engine.total_hits("cat the", "and") == 1 and engine.total_hits("zzqqxx") == 0
    again = passages.union(spark.createDataFrame([(9, "p1", "again")], passages.schema))
    assert rows(src.lookup(again, "p1")) == [("p1", 9, "again")] and rows(src.lookup(again, "none")) == []


def test_binary_lists(spark):
    post = spark.createDataFrame([("t", 0, 1), ("t", 1, 2), ("t", 4, 3)], "term string, doc_id bigint, tf bigint")
    assert [bytes(r["data"]).hex() for r in index.packed_lists(post).collect()] == ["030000000300000003000000" + "000103" + "010203"]


def test_long_passages_are_numbered(spark):
    text = " ".join(f"w{i % 5000}" for i in range(100_000))
    p = spark.createDataFrame([(0, "a", "w1 w0 w1"), (3, "b", text)], "doc_id bigint, passage_id string, text string")
    got = index.numbered_postings(p, 5).collect()
    assert len(got) == 5002 and max(r["block_no"] for r in got) == 1000
    assert {(r["term"], r["tf"]) for r in got if r["block_no"] == 0} == {("w1", 2), ("w0", 1), ("w0", 20), ("w1", 20), ("w2", 20)}


def test_stream_of_passages(spark, tmp_path):
    schema = "doc_id bigint, passage_id string, text string"
    for n, part in enumerate((CORPUS[:2], CORPUS[2:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in/*"))
        append.start(stream, str(tmp_path / "i"), str(tmp_path / "cp"), once=True).awaitTermination()
    assert hits(append.open_segments(spark, str(tmp_path / "i")).search("cat the")) == EXPECTED["cat the", "or"]


def test_text_and_format(spark, engine, passages):
    with_text = search.with_text(engine.search("dog sat", "or"), passages)
    assert [r["line"] for r in search.formatted(with_text).orderBy("rank").collect()] == ["1. [Doc 1] [Score: 0.6803] the dog sat on the mat", "2. [Doc 0] [Score: 0.0000] The cat sat"]


def test_snippets():
    assert snippets.snippet("a <b> Cat & dog", ["cat"]) == "a &lt;b&gt; <b>Cat</b> &amp; dog"
    assert snippets.snippet("x" * 400 + " cat dog " + "y" * 400, ["cat", "dog"], 20).startswith("<b>cat</b> <b>dog</b>")
    assert snippets.snippet(None, ["a"]) == "" and snippets.snippet("catalog", ["cat"]) == "catalog"


def test_splits_and_order_change_nothing(spark, passages, engine):
    other = search.SearchEngine.from_passages(passages.repartition(5).orderBy("text"))
    assert hits(other.search("the sat", "or")) == hits(engine.search("sat the sat", "or"))


def test_passages_of_a_folder_need_no_more_columns(spark, tmp_path):
    spark.createDataFrame([(0, "a", "cat", 1)], "doc_id bigint, passage_id string, passage_text string, text int").write.parquet(str(tmp_path / "passage_collection.parquet"))
    assert rows(src.read_passages(spark, str(tmp_path))) == [(0, "a", "cat")]
