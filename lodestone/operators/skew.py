"""Per-key totals and exact per-key quantiles that stay even when one key holds a large part of all rows.

Nothing here gathers the rows of a key. Counts are combined before they are shuffled, quantiles come from rounds of
histograms whose counts merge, and joins on the key treat the few heavy keys apart from the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.storage import cut

HEAVY_SHARE = 0.005  # a key with this share of the rows is heavy; there are at most 1 / HEAVY_SHARE of them
SIGN = -(1 << 63)
SMALL = 1_000_000  # keys of 8 bytes that may be broadcast


def heavy_keys(counts: DataFrame, key: str, n: str, share: float = HEAVY_SHARE) -> list:
    """The keys that hold at least ``share`` of the sum of ``n``: at most 1 / share values. Null is no key."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    rows = counts.where(F.col(key).isNotNull() & (F.col(n) >= share * total) & (F.col(n) > 0)).select(key).limit(int(1 / share) + 1)
    return [r[0] for r in rows.collect()]


def skew_join(rows: DataFrame, per_key: DataFrame, key: str, heavy: list, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``per_key`` on ``key``, which takes the ``heavy`` keys by broadcast and the rest by shuffle.

    per_key holds few rows of each key; of heavy keys there are at most 1 / HEAVY_SHARE, which bounds the broadcast.
    """
    if not heavy:
        return rows.join(per_key, key, how)
    is_heavy = F.coalesce(F.col(key).isin(heavy), F.lit(False))
    a = rows.where(is_heavy).join(F.broadcast(per_key.where(is_heavy)), key, how)
    b = rows.where(~is_heavy).join(per_key.where(~is_heavy), key, how)
    return a.unionByName(b)


def semi_join(rows: DataFrame, keys: DataFrame, key: str, most: int = SMALL) -> DataFrame:
    """``rows`` whose ``key`` is among ``keys(key)``. Keys are counted first: up to ``most`` are broadcast, which spares ``rows`` the shuffle; more are shuffled."""
    held = cut(keys.select(key).dropna().distinct())
    return rows.join(F.broadcast(held) if held.count() <= most else held, key, "left_semi")


def salted_join(rows: DataFrame, per_key: DataFrame, key: str, heavy: list, spread: str, parts: int = 32) -> DataFrame:
    """The inner join on ``key`` where per_key can hold many rows of a heavy key, too many to broadcast.

    Rows of a heavy key are dealt to ``parts`` tasks by a hash of the column ``spread``, and per_key's rows of it are sent to each.
    """
    if not heavy:
        return rows.join(per_key, key)
    is_heavy = F.coalesce(F.col(key).isin(heavy), F.lit(False))
    dealt = rows.withColumn("_salt", F.when(is_heavy, F.pmod(F.xxhash64(spread), F.lit(parts)).cast("int")).otherwise(0))
    copied = per_key.withColumn("_salt", F.explode(F.when(is_heavy, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.join(copied, [key, "_salt"]).drop("_salt")


def key_quantiles(values: DataFrame, key: str, value: str, probs: list[float], weight: str | None = None, digit_bits: int = 8) -> DataFrame:
    """``(key, prob, quantile)``: exact discrete quantiles of an integer column for every key.

    The quantile at ``prob`` is the value of rank max(1, ceil(prob * n)) in ascending order. Null keys and values are
    ignored; ``weight`` counts a row several times. Each round keeps, for every key and prob, the range of values that
    is known to hold the rank, counts the rows of that range by the next ``digit_bits`` bits of the value, and moves into
    the bin that the rank falls in. Rounds end once all bits are known. A round's histogram has at most 2**digit_bits
    rows for a key and prob, and it is combined before the shuffle, so a key with most rows costs no task more than others.
    An empty table gives no rows.
    """
    if not probs or any(not 0 <= p <= 1 for p in probs):
        raise ValueError("probs must be numbers from 0 to 1")
    w = F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")
    # as unsigned, numbers with the sign bit flipped are in the order of the signed ones
    rows = values.select(F.col(key).alias("k"), F.col(value).cast("bigint").bitwiseXOR(F.lit(SIGN)).alias("u"), w.alias("w")).dropna().where("w > 0")
    low, high = rows.agg(F.min(F.col("u").bitwiseXOR(F.lit(SIGN))), F.max(F.col("u").bitwiseXOR(F.lit(SIGN)))).first()
    if low is None:
        return rows.select(F.col("k").alias(key), F.lit(0.0).alias("prob"), F.col("u").alias("quantile")).where(F.lit(False))
    bits = 64 if low < 0 else max(1, int(high).bit_length())
    if bits < 64:
        rows = rows.withColumn("u", F.col("u").bitwiseXOR(F.lit(SIGN)))
    totals = rows.groupBy("k").agg(F.sum("w").alias("n"), F.count("*").alias("rows"))
    heavy = heavy_keys(totals, "k", "rows")
    rank = lambda p: F.greatest(F.lit(1), F.ceil(F.lit(float(p)) * F.col("n"))).cast("bigint")
    open_ = totals.select("k", F.explode(F.array(*[F.struct(F.lit(float(p)).alias("prob"), rank(p).alias("rank")) for p in probs])).alias("q")).select("k", "q.prob", "q.rank", F.lit(0).cast("bigint").alias("prefix"))
    left = bits
    while left > 0:
        step = min(digit_bits, left)
        shift = left - step
        digit = F.shiftrightunsigned("u", shift).bitwiseAND((1 << step) - 1)
        prefix = F.lit(0).cast("bigint") if left == 64 or left == bits else F.shiftrightunsigned("u", left)
        binned = rows.groupBy("k", prefix.alias("at"), digit.alias("digit")).agg(F.sum("w").alias("n"))
        joined = skew_join(binned, open_, "k", heavy).where(F.col("at") == F.col("prefix"))
        up_to = F.sum("n").over(Window.partitionBy("k", "prob").orderBy("digit"))
        hit = joined.withColumn("up_to", up_to).where((F.col("up_to") >= F.col("rank")) & (F.col("up_to") - F.col("n") < F.col("rank")))
        open_ = hit.select("k", "prob", (F.col("rank") - F.col("up_to") + F.col("n")).alias("rank"), F.shiftleft("prefix", step).bitwiseOR(F.col("digit")).alias("prefix"))
        left = shift
        if left:
            open_ = cut(open_)
    back = F.col("prefix").bitwiseXOR(F.lit(SIGN)) if bits == 64 else F.col("prefix")
    return open_.select(F.col("k").alias(key), "prob", back.alias("quantile"))


def posting_histogram(blocks: DataFrame) -> DataFrame:
    """``(term, tf, n_rows, n)``: block rows and postings of each term by frequency, counts that merge.

    n_rows counts rows as they stand, with repeats and nulls, and is carried by one tf of each row (a null tf for rows
    without postings). n counts postings of distinct complete rows; a list with an entry that is no ``id:freq`` has none.
    """
    tfs = F.when(F.col("postings").rlike(r"^\d+:\d+(,\d+:\d+)*$"), F.regexp_replace("postings", r"\d+:", ""))
    marks = blocks.select("block_no", "term", "piece_no", F.when(F.col("block_no").isNotNull() & F.col("term").isNotNull() & F.col("piece_no").isNotNull(), tfs).alias("tfs"), F.xxhash64("postings").alias("h"))
    rows = marks.groupBy("block_no", "term", "piece_no", "tfs", "h").agg(F.count("*").alias("c"))
    each = rows.select("term", "c", F.posexplode_outer(F.split("tfs", ",")).alias("pos", "tf"))
    return each.groupBy("term", F.col("tf").cast("bigint").alias("tf")).agg(
        F.sum(F.when(F.coalesce(F.col("pos"), F.lit(0)) == 0, F.col("c")).otherwise(0)).alias("n_rows"), F.count("tf").alias("n")
    )


def term_totals(blocks: DataFrame, probs: tuple[float, ...] = (0.5, 0.9, 0.99), all_rows: int | None = None) -> DataFrame:
    """``(term, n_rows, n_postings, sum_tf, share, tf_quantiles)`` of every term of a block table.

    share is the term's part of all rows, counted as they stand, or of ``all_rows``. tf_quantiles is an array of exact quantiles of the
    frequencies, one for each of ``probs``, null for a term without postings. A null term forms a row of its own that has
    rows but no postings. Extra columns are ignored; an empty table gives no rows.
    """
    hist = cut(posting_histogram(blocks))
    all_rows = all_rows or hist.agg(F.sum("n_rows")).first()[0] or 0
    totals = hist.groupBy("term").agg(F.sum("n_rows").alias("n_rows"), F.sum("n").alias("n_postings"), F.coalesce(F.sum(F.col("tf") * F.col("n")), F.lit(0)).alias("sum_tf"))
    quant = key_quantiles(hist.where("n > 0"), "term", "tf", list(probs), weight="n", digit_bits=6)
    wide = quant.groupBy("term").agg(*[F.max(F.when(F.col("prob") == float(p), F.col("quantile"))).alias(f"q{i}") for i, p in enumerate(probs)])
    arr = F.when(F.col("q0").isNotNull(), F.array(*[F.col(f"q{i}") for i in range(len(probs))]))
    joined = totals.join(wide, "term", "left")
    return joined.select("term", "n_rows", "n_postings", "sum_tf", (F.col("n_rows") / F.lit(float(max(1, all_rows)))).alias("share"), arr.alias("tf_quantiles"), F.lit(all_rows).cast("bigint").alias("all_rows"))


def hot_terms(blocks: DataFrame, percent: int = 2) -> DataFrame:
    """Rows of ``term_totals`` of the terms, not null, with at least ``percent`` % of all rows.

    Rows are counted first, which tells the hot terms, at most 100 / percent; ranks are then resolved for these alone. A hot term with
    postings comes out once its ranks are known.
    """
    counts = cut(blocks.groupBy("term").agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = [r["term"] for r in counts.where(F.col("term").isNotNull() & (F.col("n") * 100 >= total * percent)).collect()]
    totals = term_totals(blocks.where(F.col("term").isin(hot) if hot else F.lit(False)), all_rows=total)
    return totals.where((F.col("n_rows") * 100 >= F.lit(total) * percent) & ((F.col("n_postings") == 0) | F.col("tf_quantiles").isNotNull()))
