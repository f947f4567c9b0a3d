"""Inverted-index operators as relational plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.codec import delta_decode, delta_encode, list_header, varbyte_decode, varbyte_encode, varbyte_length
from lodestone.functions.text import has_token, tokens
from lodestone.operators.prefix import before
from lodestone.operators.storage import cut
from lodestone.sources.collection import explode_postings, read_blocks


def tokenized(passages: DataFrame) -> DataFrame:
    """``(doc_id, passage_id, tokens)`` of the passages with a kept token; the others keep their doc_id unused."""
    return passages.where(has_token(F.col("text"))).select("doc_id", "passage_id", tokens(F.col("text")).alias("tokens"))


def postings(passages: DataFrame) -> DataFrame:
    """``(term, doc_id, tf)``: occurrences of each kept token in each passage, combined before the shuffle."""
    terms = passages.select("doc_id", F.explode(tokens(F.col("text"))).alias("term"))
    return terms.groupBy("term", "doc_id").agg(F.count("*").alias("tf"))


def doc_table(passages: DataFrame) -> DataFrame:
    """``(doc_id, passage_id, length)`` of the passages with a kept token."""
    return tokenized(passages).select("doc_id", "passage_id", F.size("tokens").cast("bigint").alias("length"))


def lexicon(post: DataFrame) -> DataFrame:
    """``(term, df)``: the number of postings of each term."""
    return post.groupBy("term").agg(F.count("*").alias("df"))


def doc_figures(docs: DataFrame) -> DataFrame:
    """One row ``(n_docs, avgdl, n_tokens, one)`` from a document table."""
    return docs.agg(F.count("*").alias("n_docs"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("avgdl"), F.coalesce(F.sum("length"), F.lit(0)).alias("n_tokens"), F.lit(1).alias("one"))


def lexicon_figures(lex: DataFrame) -> DataFrame:
    """One row ``(n_terms, n_postings, one)`` from a lexicon."""
    return lex.agg(F.count("*").alias("n_terms"), F.coalesce(F.sum("df"), F.lit(0)).alias("n_postings"), F.lit(1).alias("one"))


def index_figures(docs: DataFrame, lex: DataFrame) -> DataFrame:
    """One row ``(n_docs, avgdl, n_terms, n_postings, n_tokens)`` from a document table and a lexicon."""
    return doc_figures(docs).join(lexicon_figures(lex), "one").select("n_docs", "avgdl", "n_terms", "n_postings", "n_tokens")


def index_stats(docs: DataFrame, post: DataFrame) -> DataFrame:
    """``index_figures`` of a document table and postings."""
    return index_figures(docs, lexicon(post))


def delta_postings(post: DataFrame) -> DataFrame:
    """``(term, doc_id, gap, tf)``: the first doc_id of a list as it is, later ones as differences.

    The lag is taken within ranges of doc_ids, and each range's first row gets the last doc_id of the range before it
    from a small per-range table: a term with a third of all postings is spread over many tasks.
    """
    span = F.floor(F.col("doc_id") / 65536).alias("span")
    cut = post.select("term", "doc_id", "tf", span)
    ends = cut.groupBy("term", "span").agg(F.max("doc_id").alias("end"))
    before = ends.select("term", "span", F.lag("end", 1, 0).over(Window.partitionBy("term").orderBy("span")).alias("before"))
    lagged = cut.withColumn("prev", F.lag("doc_id").over(Window.partitionBy("term", "span").orderBy("doc_id")))
    return lagged.join(before, ["term", "span"]).select("term", "doc_id", (F.col("doc_id") - F.coalesce("prev", "before")).alias("gap"), "tf")


def lexicon_layout(post: DataFrame) -> DataFrame:
    """``(term, doc_count, length, offset)`` of the packed list file: 12 bytes of header and both coded arrays per term.

    Bytes are summed within ranges of doc_ids, where a range's first gap is put right from a small per-range table. The running offset is a
    sum within ranges of terms, each a task's share, and over the few ranges: no task sorts all terms.
    """
    size = lambda n: varbyte_length(n)
    span = F.floor(F.col("doc_id") / 65536).alias("span")
    lagged = post.select("term", "doc_id", "tf", span).withColumn("prev", F.lag("doc_id").over(Window.partitionBy("term", "span").orderBy("doc_id")))
    inner = F.sum(size(F.col("tf")) + F.coalesce(size(F.col("doc_id") - F.col("prev")), F.lit(0)))
    spans = lagged.groupBy("term", "span").agg(F.count("*").alias("n"), inner.alias("bytes"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    gap = F.col("low") - F.lag("high", 1, 0).over(Window.partitionBy("term").orderBy("span"))
    per = spans.withColumn("gap", gap).groupBy("term").agg(F.sum("n").alias("doc_count"), (F.sum(F.col("bytes") + size(F.col("gap"))) + 12).alias("length"))
    ranged = cut(per.repartitionByRange("term").withColumn("part", F.spark_partition_id()))
    parts = ranged.groupBy("part").agg(F.sum("length").alias("all"))
    first = parts.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("first"))
    inside = F.sum("length").over(Window.partitionBy("part").orderBy("term")) - F.col("length")
    return ranged.withColumn("inside", inside).join(first, "part").select("term", "doc_count", "length", (F.col("first") + F.col("inside")).alias("offset"))


def posting_numbers(passages: DataFrame, max_postings: int) -> DataFrame:
    """``(block_no, term, doc_id)``: postings cut into blocks of ``max_postings`` in the order of doc_ids.

    Within a passage postings stand in order of first occurrence. The number of a passage's first posting is a running sum in levels
    of doc_ids. max_postings below 1 raises ValueError.
    """
    if max_postings < 1:
        raise ValueError("max_postings must be at least 1")
    distinct = tokenized(passages).select("doc_id", F.array_distinct("tokens").alias("terms")).withColumn("n_terms", F.size("terms"))
    each = before(distinct, "doc_id", "n_terms", "base").select("doc_id", "base", F.posexplode("terms").alias("pos", "term"))
    return each.select(F.floor((F.col("base") + F.col("pos")) / max_postings).cast("bigint").alias("block_no"), "term", "doc_id")


def numbered_postings(passages: DataFrame, max_postings: int) -> DataFrame:
    """``(block_no, term, doc_id, tf)``: ``posting_numbers`` with frequencies."""
    return posting_numbers(passages, max_postings).join(postings(passages), ["term", "doc_id"])


def block_stats(passages: DataFrame, max_postings: int = 50_000) -> DataFrame:
    """``(block_no, n_postings, n_terms)`` of the blocks of ``posting_numbers``."""
    per_term = posting_numbers(passages, max_postings).groupBy("block_no", "term").agg(F.count("*").alias("n"))
    return per_term.groupBy("block_no").agg(F.sum("n").alias("n_postings"), F.count("*").alias("n_terms"))


def merge_blocks(blocks: DataFrame) -> DataFrame:
    """``(term, doc_id, tf)`` of all blocks: the k-way merge, flat. Sort by (term, doc_id) to write it.

    The list of a term is never gathered in one task. Entries that occur in two pieces with different text stay apart.
    """
    return explode_postings(read_blocks(blocks), "term")


def write_sorted(post: DataFrame, path: str, partitions: int | None = None) -> None:
    """Write postings range-partitioned and sorted by (term, doc_id), so that a term lookup skips almost all files.

    Terms and frequencies are dictionary coded, the ascending doc_ids as packed differences: a quarter of the size of the default layout.
    """
    ranged = post.repartitionByRange(partitions, "term", "doc_id") if partitions else post.repartitionByRange("term", "doc_id")
    layout = {"compression": "zstd", "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary#doc_id": "false"}
    ranged.sortWithinPartitions("term", "doc_id").write.mode("overwrite").options(**layout).parquet(path)


def seek(post: DataFrame, term: str, target: int) -> DataFrame:
    """The first posting ``(doc_id, tf)`` of ``term`` with doc_id >= target; no row if there is none."""
    return post.where((F.col("term") == term) & (F.col("doc_id") >= target)).orderBy("doc_id").limit(1).select("doc_id", "tf")


def next_doc(post: DataFrame, term: str, current: int) -> DataFrame:
    """The posting ``(doc_id, tf)`` of ``term`` that follows doc_id ``current``."""
    return seek(post, term, current + 1)


def packed_postings(post: DataFrame, span: int = 65536) -> DataFrame:
    """``(term, span_no, doc_count, doc_bytes, tf_bytes)``: lists as variable-byte gaps and frequencies.

    A list is cut at multiples of ``span`` doc_ids, and the first gap of a part counts from there: no task holds more than ``span`` postings
    of a term, and a reader can skip to the part of a doc_id.
    """
    at = F.floor(F.col("doc_id") / span).cast("bigint")
    cut = post.groupBy("term", at.alias("span_no")).agg(F.array_sort(F.collect_list(F.struct("doc_id", "tf"))).alias("p"))
    gaps = delta_encode(F.col("p.doc_id"), F.col("span_no") * span)
    return cut.select("term", "span_no", F.size("p").cast("bigint").alias("doc_count"), varbyte_encode(gaps).alias("doc_bytes"), varbyte_encode(F.col("p.tf")).alias("tf_bytes"))


def packed_lists(post: DataFrame) -> DataFrame:
    """``(term, span_no, data)``: the parts of ``packed_postings`` as they stand in a binary file: header, coded gaps, coded frequencies."""
    header = list_header(F.col("doc_count"), F.octet_length("doc_bytes"), F.octet_length("tf_bytes"))
    return packed_postings(post).select("term", "span_no", F.concat(header, "doc_bytes", "tf_bytes").alias("data"))


def unpacked_postings(packed: DataFrame, span: int = 65536) -> DataFrame:
    """``(term, doc_id, tf)`` of packed lists."""
    ids = F.transform(delta_decode(varbyte_decode(F.col("doc_bytes"))), lambda x: x + F.col("span_no") * span)
    pairs = packed.select("term", F.explode(F.arrays_zip(ids.alias("doc_id"), varbyte_decode(F.col("tf_bytes")).alias("tf"))).alias("e"))
    return pairs.select("term", "e.doc_id", "e.tf")


def write_blocks(passages: DataFrame, path: str, max_postings: int = 5_000_000) -> None:
    """Text blocks ``block_no=N`` of lines ``term TAB doc_id:freq,...``, each sorted by term."""
    entry = F.concat_ws(":", "doc_id", "tf")
    numbered = numbered_postings(passages, max_postings)
    lists = numbered.groupBy("block_no", "term").agg(F.array_sort(F.collect_list(F.struct("doc_id", entry.alias("e")))).alias("p"))  # a block's part of a list
    lines = lists.select("block_no", "term", F.concat_ws("\t", "term", F.array_join(F.transform("p", lambda x: x.e), ",")).alias("value"))
    lines.repartition("block_no").sortWithinPartitions("block_no", "term").select("block_no", "value").write.mode("overwrite").partitionBy("block_no").text(path)
