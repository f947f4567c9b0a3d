import math

import pytest
from conftest import rows
from pyspark.sql import functions as F

from lodestone.llm import terms

BLOCK = [
    (0, "aa", 0, "0:3,1:1"), (0, "aa", 0, "0:3,1:1"), (0, "aa", 1, "2:1"), (1, "aa", 0, "70:5"), (0, "bb", 0, "1:4"), (1, "bb", 0, "70:1"), (0, "cc", 0, "0:2"), (0, None, 0, "0:9"), (0, "dd", 0, None), (None, "aa", 0, "0:3"), (0, "ee", 0, "9:1"),
]
DOCS = [(0, "p", 10, 1), (0, "p", 99, 0), (1, None, 8, 1), (1, None, 8, 1), (2, "q", None, 1), (70, "r", 20, 1), (5, "s", 0, 1), (None, "t", 7, 1)]
LEXICON = [(0, "aa", 3, 1), (0, "aa", 3, 1), (0, "aa", None, 0), (1, "aa", 1, 1), (0, "bb", 9, 0), (0, "bb", 1, 2), (1, "bb", 1, 1), (0, "zz", None, 5), (0, None, 7, 1), (0, "ff", 3, 1)]


@pytest.fixture
def tables(spark):
    extra = lambda df: df.withColumn("df", F.lit("x")).withColumn("n", F.lit(1))
    return (
        extra(spark.createDataFrame(BLOCK, "block_no int, term string, piece_no int, postings string")),
        extra(spark.createDataFrame(DOCS, "doc_id bigint, passage_id string, length bigint, written_at int")),
        extra(spark.createDataFrame(LEXICON, "block_no int, term string, doc_count bigint, written_at int")),
    )


def brute():
    tf = {("aa", 0): 3, ("aa", 1): 1, ("aa", 2): 1, ("aa", 70): 5, ("bb", 1): 4, ("bb", 70): 1, ("cc", 0): 2, ("ee", 9): 1}
    length, n = {0: 10, 1: 8, 70: 20}, 5
    out = {}
    for (t, d), f in tf.items():
        df = sum(x == t for x, _ in tf)
        cf = sum(v for (x, _), v in tf.items() if x == t)
        ridf = math.log(n / df) + math.log(1 - math.exp(-cf / n))
        w = f / length[d] * math.log(n / df) / math.log(n) if d in length else None
        out[d, t] = (f, df, cf, round(ridf, 9), round(f * ridf, 9), None if w is None else round(w, 9))
    return out


def test_scores_against_brute_force(tables):
    block, docs, _ = tables
    for least in (1, 3):
        got = {(r["doc_id"], r["term"]): (r["tf"], r["df"], r["cf"], round(r["residual_idf"], 9), round(r["score"], 9), None if r["weight"] is None else round(r["weight"], 9)) for r in terms.distinctive_terms(block, docs).where(f"tf >= {least}").collect()}
        assert got == {k: v for k, v in brute().items() if v[0] >= least}


def test_bitmaps_and_marks(tables):
    block, docs, lexicon = tables
    maps = {(r["term"], r["block_no"]): (bytes(r["words"]).hex(), bytes(r["bits"]).hex(), r["occurrences"]) for r in terms.term_bitmaps(block).collect()}
    assert maps["aa", 0] == ("00000000", "0000000000000007", 5) and maps["aa", 1] == ("00000000", "0000000000000040", 5)
    got = {r["term"]: (r["df"], r["occurrences"], r["lexicon_df"], r["mark"]) for r in terms.term_frequencies(block, lexicon, docs).collect()}
    assert got == {"aa": (4, 10, 4, "common"), "bb": (2, 5, 2, "rare"), "cc": (1, 2, None, "rare"), "ee": (1, 1, None, "rare"), "zz": (None, None, None, None), "ff": (None, None, 3, "common")}


def test_a_document_in_two_pieces_counts_once(spark, tables):
    block = spark.createDataFrame([(0, "aa", 0, "3:1,130:2"), (0, "aa", 1, "3:4,63:1,127:1")], "block_no int, term string, piece_no int, postings string")
    r = terms.term_bitmaps(block).first()
    assert bytes(r["words"]).hex() == "00000000" + "00000001" + "00000002" and bytes(r["bits"]).hex() == "8000000000000008" + "8000000000000000" + "0000000000000004"
    assert [(x["df"], x["occurrences"]) for x in terms.term_frequencies(block, tables[2].where("false"), tables[1]).collect()] == [(4, 9)]


def test_residual_scores_of_the_found_terms(spark):
    """The rows of p6_found are rows of p6_scores, of terms that crowd into few documents or are rare."""
    from conftest import DATA

    from lodestone.llm import registry

    if not DATA.exists():
        pytest.skip("needs the test tables")
    scores = {(r["doc_id"], r["term"]): r for r in registry.p6_scores(spark, str(DATA)).collect()}
    found = {(r["doc_id"], r["term"]) for r in registry.p6_found(spark, str(DATA)).collect()}
    assert found and found <= set(scores)
    mean = lambda keys: sum(scores[k]["residual_idf"] for k in keys) / len(keys)
    assert mean(found) > mean(set(scores) - found)


def test_empty_tables(tables):
    block, docs, lexicon = (t.where("false") for t in tables)
    assert terms.distinctive_terms(block, docs).count() == 0
    assert terms.term_frequencies(block, lexicon, docs).count() == 0
    assert rows(terms.distinctive_terms(tables[0], docs).select("score").distinct()) == [(None,)]
