"""Named queries of this package and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import encodings, mixing, near_duplicates, packing, templates, terms, text_types
from lodestone.sources.collection import read_table


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table whose texts Python works on, dealt to all cores."""
    return read_table(spark, d, name, spark.sparkContext.defaultParallelism)


def _types(spark: SparkSession, d: str) -> DataFrame:
    return text_types.text_types(_table(spark, d, "passage_collection"), read_table(spark, d, "doc_table"), read_table(spark, d, "common_words"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _types(spark, d).where("type <> 'prose'").select("doc_id")


def p1_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Statistics and posterior text types of every passage that is not blank."""
    return _types(spark, d)


def p1_accuracies(spark: SparkSession, d: str) -> DataFrame:
    """The learned share of each text type and how each labelling function votes on it."""
    return text_types.accuracies(_table(spark, d, "passage_collection"), read_table(spark, d, "doc_table"), read_table(spark, d, "common_words"))


def _restored(spark: SparkSession, d: str) -> DataFrame:
    return encodings.restored(_table(spark, d, "passage_collection"), read_table(spark, d, "common_words"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _restored(spark, d).select(F.col("id").alias("doc_id"))


def p2_restored(spark: SparkSession, d: str) -> DataFrame:
    """Garbled passages with their restored text and the decodings undone."""
    return _restored(spark, d).withColumnRenamed("id", "doc_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of passages with at least 10 runs of three tokens each, of which 0.6 of the runs in either or both are common."""
    return near_duplicates.duplicate_pairs(_table(spark, d, "passage_collection"), "doc_id", "passage_text", width=3, share=0.6, min_runs=10)


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    """Each passage with its group and the number of links of its class."""
    return near_duplicates.duplicate_groups(_table(spark, d, "passage_collection"), "doc_id", "passage_text", width=3, share=0.6, min_runs=10)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    t = terms.distinctive_terms(read_table(spark, d, "block"), read_table(spark, d, "doc_table"))
    return t.where("tf >= 3 and df >= 2 and weight >= 0.05D").select("doc_id", "term")


def p6_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every term of every passage with its residual inverse document frequency and score."""
    t = terms.distinctive_terms(read_table(spark, d, "block"), read_table(spark, d, "doc_table"))
    return t.select("doc_id", "term", "tf", "df", "cf", F.round("residual_idf", 6).alias("residual_idf"), F.round("score", 5).alias("score"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    t = terms.term_frequencies(*(read_table(spark, d, x) for x in ("block", "lexicon", "doc_table")))
    return t.where("lexicon_df is not null and mark in ('rare', 'common')").select("term")


def p7_frequencies(spark: SparkSession, d: str) -> DataFrame:
    """Passages and occurrences of every term, with its mark."""
    return terms.term_frequencies(*(read_table(spark, d, x) for x in ("block", "lexicon", "doc_table")))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """The container of every document, or of its parts, for each container size."""
    return packing.containers(_table(spark, d, "documents"), read_table(spark, d, "container_spec")).withColumnRenamed("item_id", "doc_id")


def p8_summary(spark: SparkSession, d: str) -> DataFrame:
    """Containers needed and how full they are, for each container size."""
    return packing.summary(p8_containers(spark, d), read_table(spark, d, "container_spec"))


def p9_selection(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each mix and how often each is used."""
    return mixing.mix(_table(spark, d, "documents"), read_table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares of the sources of each mix, wanted and reached."""
    return mixing.shares(p9_selection(spark, d), read_table(spark, d, "mix_targets"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return templates.template_residue(_table(spark, d, "documents"), site_col="site").select(F.col("id").alias("doc_id"))


def p10_clean(spark: SparkSession, d: str) -> DataFrame:
    """Documents without template residue."""
    return templates.without_residue(_table(spark, d, "documents"), site_col="site").select("doc_id", "lang", "source", "n_chars")


QUERIES = {"p8_containers": p8_containers, "p8_summary": p8_summary, "p9_selection": p9_selection, "p9_shares": p9_shares, "p1_found": p1_found, "p1_statistics": p1_statistics, "p1_accuracies": p1_accuracies, "p2_found": p2_found, "p2_restored": p2_restored, "p10_found": p10_found, "p10_clean": p10_clean, "p3_found": p3_found, "p3_groups": p3_groups, "p6_found": p6_found, "p6_scores": p6_scores, "p7_found": p7_found, "p7_frequencies": p7_frequencies}

_ENTRIES = """e AS (SELECT term, CAST(split_part(x, ':', 1) AS BIGINT) AS doc_id, CAST(split_part(x, ':', 2) AS BIGINT) AS tf FROM (SELECT term, unnest(string_split(postings, ',')) AS x
  FROM (SELECT DISTINCT block_no, term, piece_no, postings FROM block WHERE block_no IS NOT NULL AND term IS NOT NULL AND piece_no IS NOT NULL AND postings IS NOT NULL))),
s AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM e GROUP BY term),
n AS (SELECT CAST(count(DISTINCT doc_id) AS DOUBLE) AS n FROM doc_table)"""
_LENGTH = """len AS (SELECT doc_id, length FROM (SELECT doc_id, length, row_number() OVER (PARTITION BY doc_id ORDER BY written_at DESC) AS r FROM doc_table) WHERE r = 1)"""
_LEX = """lex AS (SELECT term, CAST(sum(doc_count) AS BIGINT) AS lexicon_df FROM (SELECT term, doc_count, row_number() OVER (PARTITION BY block_no, term ORDER BY written_at DESC) AS r FROM lexicon
  WHERE term IS NOT NULL AND block_no IS NOT NULL) WHERE r = 1 GROUP BY term)"""

_RUNS = """toks AS (SELECT doc_id, list_filter(regexp_extract_all(lower(coalesce(passage_text, '')), '[a-z0-9]+'), lambda x: length(x) between 2 and 20) AS t FROM passage_collection),
r AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(t) - 1), lambda i: array_to_string(t[i:i + 2], ' '))) AS run FROM toks WHERE len(t) >= 3),
n AS (SELECT doc_id, count(*) AS n FROM r GROUP BY doc_id HAVING count(*) >= 10)"""

ORACLE = {
    "p3_found": f"""WITH {_RUNS}, c AS (SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b, count(*) AS common FROM r a JOIN r b ON a.run = b.run AND a.doc_id < b.doc_id GROUP BY ALL)
SELECT doc_id_a, doc_id_b FROM c JOIN n x ON x.doc_id = doc_id_a JOIN n y ON y.doc_id = doc_id_b WHERE common * 10 >= 6 * (x.n + y.n - common)""",
    "p6_found": f"WITH {_ENTRIES}, {_LENGTH} SELECT doc_id, term FROM e JOIN s USING (term) JOIN len USING (doc_id), n WHERE tf >= 3 AND df >= 2 AND (tf / length) * ln(n / df) / ln(n) >= CAST(0.05 AS DOUBLE)",
    "p6_scores": f"""WITH {_ENTRIES}, r AS (SELECT doc_id, term, tf, df, cf, ln(n / df) + ln(CAST(1 AS DOUBLE) - exp(-cf / n)) AS ridf FROM e JOIN s USING (term), n)
SELECT doc_id, term, tf, df, cf, round(ridf, 6) AS residual_idf, round(tf * ridf, 5) AS score FROM r""",
    "p7_found": f"WITH {_LEX}, n AS (SELECT count(DISTINCT doc_id) AS n FROM doc_table) SELECT term FROM lex, n WHERE lexicon_df <= 2 OR lexicon_df * 5 > n",
    "p7_frequencies": f"""WITH {_ENTRIES}, {_LEX} SELECT coalesce(s.term, lex.term) AS term, df, cf AS occurrences, lexicon_df,
  CASE WHEN coalesce(lexicon_df, df) <= 2 THEN 'rare' WHEN coalesce(lexicon_df, df) * 5 > n THEN 'common' ELSE 'useful' END AS mark FROM s FULL JOIN lex ON s.term = lex.term, n""",
}
