"""Passage collections: TSV files, Parquet tables and posting blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.text import drop_invalid_utf8, strip


def read_table(spark: SparkSession, folder: str, name: str, spread: int = 0) -> DataFrame:
    """The Parquet table ``name`` of ``folder``; with ``spread``, one in fewer splits than that is dealt out to as many tasks.

    A file of one row group is one split, however many cores there are, which costs more than the shuffle where Python works on each row.
    """
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.repartition(spread) if spread > 1 and df.rdd.getNumPartitions() < spread else df


def read_passages(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, passage_id, text)`` of the table passage_collection; ids are used as they are."""
    return read_table(spark, folder, "passage_collection", spark.sparkContext.defaultParallelism).select("doc_id", "passage_id", F.col("passage_text").alias("text"))


def lookup(passages: DataFrame, passage_id: str) -> DataFrame:
    """``(passage_id, doc_id, text)`` of one passage: the last that was delivered under its id, no row for an unknown id. The filter reaches the scan."""
    found = passages.where(F.col("passage_id") == F.lit(passage_id)).orderBy(F.desc("doc_id")).limit(1)
    return found.select("passage_id", "doc_id", "text")


def parse_tsv_line(line: Column) -> tuple[Column, Column, Column]:
    """``(is_passage, passage_id, text)`` of a line: stripped, then split at the first tab into exactly two parts."""
    parts = F.split(strip(drop_invalid_utf8(line)), "\t", 2)
    return F.size(parts) == 2, F.get(parts, 0), F.get(parts, 1)


def read_tsv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(doc_id, passage_id, text)`` of TSV files, doc_ids dense in the order of path, then place in the file.

    Blank lines and lines without a tab are skipped and take no doc_id. The numbering needs no global sort: rows are
    counted per file split, the splits' first numbers are summed up over that small table, and each row adds its rank
    within its split.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("seq")
    )
    ok, pid, text = parse_tsv_line(F.col("value"))
    kept = lines.where(ok).select("file", "start", "seq", pid.alias("passage_id"), text.alias("text"))
    sizes = kept.groupBy("file", "start").agg(F.count("*").alias("n"))  # a row for each split of 128 MB or so
    first = sizes.select("file", "start", (F.sum("n").over(Window.orderBy("file", "start")) - F.col("n")).alias("first"))
    rank = F.row_number().over(Window.partitionBy("file", "start").orderBy("seq")) - 1
    return kept.withColumn("rank", rank).join(first, ["file", "start"]).select((F.col("first") + F.col("rank")).alias("doc_id"), "passage_id", "text")


def read_blocks(blocks: DataFrame) -> DataFrame:
    """Distinct complete rows ``(block_no, term, piece_no, postings)`` of a block table.

    Rows with a null in any of the four columns are aborted writes and are dropped, repeated rows count once; other
    columns are ignored. One shuffle on (term, block_no): no such group outgrows its block, whatever the term, and
    later steps that group by these and further columns need no second one.
    """
    cols = ["block_no", "term", "piece_no", "postings"]
    return blocks.select(*cols).dropna().repartition("term", "block_no").dropDuplicates(cols)


def explode_postings(blocks: DataFrame, *keep: str) -> DataFrame:
    """``(*keep, doc_id, tf)``, one row for each well-formed ``doc_id:freq`` entry of ``postings``.

    A row with any entry that is not ``digits:digits`` is dropped whole; empty lists give no row.
    """
    good = blocks.where(F.col("postings").rlike(r"^\d+:\d+(,\d+:\d+)*$"))
    entry = good.select(*keep, F.explode(F.split("postings", ",")).alias("e"))
    return entry.select(*keep, F.substring_index("e", ":", 1).cast("bigint").alias("doc_id"), F.substring_index("e", ":", -1).cast("bigint").alias("tf"))


def read_block_files(spark: SparkSession, path: str) -> DataFrame:
    """``(block_no, term, piece_no, postings)`` of text blocks ``term TAB postings``; bad lines are skipped.

    The number is that of a folder ``block_no=N``, else the last number in the file's name.
    """
    name = F.input_file_name()
    number = F.coalesce(F.nullif(F.regexp_extract(name, r"block_no=(\d+)/", 1), F.lit("")), F.regexp_extract(name, r"(\d+)[^/\d]*$", 1))
    lines = spark.read.text(path).select(F.split("value", "\t").alias("p"), number.cast("int").alias("block_no"))
    good = lines.where((F.size("p") == 2) & (F.trim(F.get("p", F.lit(0))) != ""))
    return good.select("block_no", F.get("p", F.lit(0)).alias("term"), F.lit(0).alias("piece_no"), F.get("p", F.lit(1)).alias("postings"))


def latest(table: DataFrame, keys: list[str], value: str, order: str = "written_at") -> DataFrame:
    """``(*keys, value)`` of the latest row of each key by ``order``; a null key is dropped.

    Computed with max_by, thus combined before the shuffle. Of equally late rows the one with the largest value holds.
    """
    rows = table.select(*keys, value, order).dropna(subset=keys)
    held = rows.groupBy(*keys).agg(F.max(F.struct(F.col(order), F.col(value))).alias("_m"))
    return held.select(*keys, F.col("_m")[value].alias(value))
