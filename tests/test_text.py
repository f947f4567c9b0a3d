from conftest import rows
from pyspark.sql import functions as F

from lodestone.functions import text


def tokens(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["k"] for r in df.select("i", text.tokens(F.col("t")).alias("k")).orderBy("i").collect()]


def test_token_rule(spark):
    long, over = "a" * 20, "b" * 21
    got = tokens(spark, "A1 x it's ÉTÉ été", f"{long} {over}", "U.S. 2024-01", "foo_bar", "Kb", "", "a b", None, "İx1")
    assert got == [["a1", "it"], [long], ["2024", "01"], ["foo", "bar"], ["kb"], [], [], [], ["x1"]]


def test_query_terms_are_distinct_in_order():
    assert text.query_terms("The the CAT a cat-dog") == ["the", "cat", "dog"]


def test_strip_takes_all_white_space(spark):
    df = spark.createDataFrame([("\u001c\u0085 　 x y \t ",), (None,), ("",)], "t string")
    assert rows(df.select(text.strip(F.col("t")))) == [("",), ("x y",), (None,)]


def test_invalid_utf8_bytes_are_dropped(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"1\tab\xffcd ef\n2\tgood \xef\xbf\xbd\n")
    df = spark.read.text(str(tmp_path / "a.txt")).select(text.drop_invalid_utf8(F.col("value")))
    assert rows(df) == [("1\tabcd ef",), ("2\tgood �",)]
