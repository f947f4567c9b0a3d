"""Statistics of terms: how distinctive a term is of a record, and how frequent it is in the collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.skew import heavy_keys, skew_join
from lodestone.operators.storage import cut
from lodestone.sources.collection import explode_postings, latest, read_blocks

RARE_DF, COMMON_SHARE = 2, 0.2


def doc_lengths(doc_table: DataFrame) -> DataFrame:
    """``(doc_id, length)``: the length that holds for each document; it can be null."""
    return latest(doc_table, ["doc_id"], "length")


def n_docs(doc_table: DataFrame) -> int:
    """Distinct doc_ids of a document table."""
    return doc_table.where("doc_id is not null").select("doc_id").distinct().count()


def distinctive_terms(blocks: DataFrame, doc_table: DataFrame) -> DataFrame:
    """``(doc_id, term, tf, df, cf, length, residual_idf, expected_idf, score, weight)`` for every term of every document.

    With N documents in ``doc_table``, df of them holding the term and cf occurrences in all, expected_idf is what a Poisson spread of cf
    occurrences would give, -ln(1 - exp(-cf / N)), and residual_idf the observed ln(N / df) less that: it is near zero
    for terms spread evenly, common or not, and high for terms that crowd into few documents. score = tf * residual_idf.
    weight = (tf / length) * (residual_idf + expected_idf) / ln(N), the residual with the expectation put back, for thresholds on plain idf.

    Block rows with a null are ignored, repeated rows count once. A document without a row in doc_table, or with a null or
    zero length, has a null length and weight; N = 1 gives a null weight, N = 0 null scores. Empty tables give no rows. The terms with
    most rows are joined apart.
    """
    n = n_docs(doc_table)
    rows = cut(read_blocks(blocks))
    each = explode_postings(rows, "term")
    stats = cut(each.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")))
    heavy = heavy_keys(stats, "term", "df")
    full = skew_join(each, stats, "term", heavy).join(doc_lengths(doc_table), "doc_id", "left")
    big_n, df, cf = F.lit(float(n)), F.col("df").cast("double"), F.col("cf").cast("double")
    expected = -F.log(F.lit(1.0) - F.exp(-cf / F.nullif(big_n, F.lit(0.0))))
    residual = F.log(big_n / df) - expected
    length = F.nullif(F.col("length"), F.lit(0))
    scored = full.select("doc_id", "term", "tf", "df", "cf", length.alias("length"), residual.alias("residual_idf"), expected.alias("expected_idf"))
    weight = (F.col("tf") / F.col("length")) * (F.col("residual_idf") + F.col("expected_idf")) / F.nullif(F.log(big_n), F.lit(0.0))
    return scored.select("*", (F.col("tf") * F.col("residual_idf")).alias("score"), weight.alias("weight"))


def term_bitmaps(blocks: DataFrame) -> DataFrame:
    """``(term, block_no, words, bits, occurrences)``: the documents of each term as a compressed bitmap, stored vertically, with a counter beside it.

    A bitmap is kept as its non-zero words of 64 document identifiers: bit ``doc_id % 64`` of word ``doc_id div 64``. ``bits`` has these words
    one after the other, eight bytes each, and ``words`` their numbers less that of the first, four bytes each, ascending. Pieces are merged by
    union (bit_or), so a document that stands in two pieces of a block counts once. A document is in one block, so cardinalities of
    different blocks add up. Rows with a null are ignored and repeated rows count once. The one shuffle is on (term, block_no), a group that no
    hot term outgrows.
    """
    each = explode_postings(read_blocks(blocks), "term", "block_no")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("doc_id").bitwiseAND(63).cast("int"))
    words = each.select("term", "block_no", F.shiftright("doc_id", 6).alias("word"), bit.alias("bit"), "tf")
    merged = words.groupBy("term", "block_no", "word").agg(F.bit_or("bit").alias("bits"), F.sum("tf").alias("occurrences"))
    lists = merged.groupBy("term", "block_no").agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("w"), F.sum("occurrences").alias("occurrences"))
    packed = lambda digits, number: F.unhex(F.array_join(F.transform("w", lambda x: F.lpad(F.hex(number(x)), digits, "0")), ""))
    return lists.select("term", "block_no", packed(8, lambda x: x.word - F.col("w")[0].word).alias("words"), packed(16, lambda x: x.bits).alias("bits"), "occurrences")


def term_frequencies(blocks: DataFrame, lexicon: DataFrame, doc_table: DataFrame) -> DataFrame:
    """``(term, df, occurrences, lexicon_df, mark)`` for every term of lexicon or block.

    df is the cardinality of the term's bitmaps and occurrences the sum of their counters; lexicon_df is the sum of the doc_counts that
    hold, to be compared with it. mark is "rare" for a df of at most 2, "common" for one of more than a fifth of the documents of
    doc_table, else "useful"; only a term without any list is marked by lexicon_df. A null term is no term. Missing values are null; empty
    tables give no rows.
    """
    n = n_docs(doc_table)
    own = term_bitmaps(blocks).groupBy("term").agg(F.sum(F.bitmap_count("bits")).alias("df"), F.sum("occurrences").alias("occurrences"))
    told = latest(lexicon, ["block_no", "term"], "doc_count").groupBy("term").agg(F.sum("doc_count").alias("lexicon_df"))
    both = own.join(told, "term", "full")
    held = F.coalesce("df", "lexicon_df")
    mark = F.when(held <= RARE_DF, "rare").when(held * 5 > n, "common").when(held.isNotNull(), "useful")
    return both.select("term", "df", "occurrences", "lexicon_df", mark.alias("mark"))
