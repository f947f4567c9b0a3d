from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.sources import collection as src
from lodestone.sources import raw_lines


def test_tsv_scan(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("1\tfoo\n\n  3\tlead\nno-tab\n4\t\n\ttext\n6\tz\ty\n9\t!\n1\tagain\n", encoding="utf-8")
    (tmp_path / "b.tsv").write_text("7\tseven\r\n8\teight\n", encoding="utf-8")
    got = rows(src.read_tsv(spark, str(tmp_path)))
    assert got == [(0, "1", "foo"), (1, "3", "lead"), (2, "6", "z\ty"), (3, "9", "!"), (4, "1", "again"), (5, "7", "seven"), (6, "8", "eight")]


def test_tsv_numbering_does_not_depend_on_splits(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("".join(f"{i}\ttext {i}\n" for i in range(3000)), encoding="utf-8")
    (tmp_path / "b.tsv").write_text("x\ty\n", encoding="utf-8")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        got = rows(src.read_tsv(spark, str(tmp_path)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [(i, str(i), f"text {i}") for i in range(3000)] + [(3000, "x", "y")]


BLOCKS = [(0, "a", 0, "1:2,3:1", "x"), (0, "a", 0, "1:2,3:1", "x"), (0, "a", 1, "5:1", "x"), (1, "a", 0, "9:4", "x"), (0, None, 0, "1:1", "x"), (0, "b", 0, None, "x"), (0, "c", 0, "1:x", "x"), (0, "d", 0, "", "x")]


def test_blocks(spark):
    df = spark.createDataFrame(BLOCKS, "block_no int, term string, piece_no int, postings string, doc_id string")
    got = src.explode_postings(src.read_blocks(df), "term")
    assert rows(got) == [("a", 1, 2), ("a", 3, 1), ("a", 5, 1), ("a", 9, 4)]
    assert rows(src.explode_postings(src.read_blocks(df.where("false")), "term")) == []


def test_latest_row_holds(spark):
    df = spark.createDataFrame([(1, 5, 10), (1, None, 20), (2, 7, 5), (2, 7, 5), (3, 1, None), (None, 4, 9)], "k int, v int, written_at int")
    assert rows(src.latest(df, ["k"], "v")) == [(1, None), (2, 7), (3, 1)]


def check(spark, lines):
    df = spark.createDataFrame(list(enumerate(lines)), "line_no bigint, raw_line string").withColumn("passage_id", df_lit())
    return [tuple(r)[1:] for r in raw_lines.parse_lines(df).orderBy("line_no").collect()]


def df_lit():
    from pyspark.sql import functions as F

    return F.lit("extra")


def test_lines(spark):
    long = "x" * 100_000
    got = check(
        spark,
        ["1\tplain", '2\t"a ""b""\tc"', '"3"\t"q"', "4\ta\tb", "5", '6\t"open', '7\t"shut" x', "1234567890\tx", "a\tx", "8\t  \t", "8\t  ", "9\tbad\x01x", "9\tbad�", '10\tit"s', "", None, f"11\t{long}", f'12\t"{long}', "13\t\"tab\tin\""],
    )
    bad = lambda why, at: (False, None, None, why, at)
    assert got == [
        (True, "1", "plain", None, None), (True, "2", 'a "b"\tc', None, None), (True, "3", "q", None, None), bad("wrong number of fields", 3), bad("wrong number of fields", 1), bad("unclosed quote", 2),
        bad("text after closing quote", 8), bad("bad passage_id", 0), bad("bad passage_id", 0), bad("wrong number of fields", 4), bad("blank passage_text", 2), bad("bad character", 5), bad("bad character", 5),
        (True, "10", 'it"s', None, None), bad("wrong number of fields", 0), bad("null line", 0), (True, "11", long, None, None), bad("unclosed quote", 3), (True, "13", "tab\tin", None, None),
    ]


def plain_parse(line):
    """Field by field, one character after the other."""
    fields, i = [], 0
    while True:
        if line[i : i + 1] == '"':
            out, i = "", i + 1
            while True:
                if i >= len(line):
                    return None
                if line[i] == '"':
                    if line[i + 1 : i + 2] != '"':
                        break
                    i += 1
                out += line[i]
                i += 1
            i += 1
            if i < len(line) and line[i] != "\t":
                return None
        else:
            j = line.find("\t", i)
            j = len(line) if j < 0 else j
            out, i = line[i:j], j
        fields.append(out)
        if i >= len(line):
            break
        i += 1
    if len(fields) != 2 or not raw_lines.ID.fullmatch(fields[0]) or raw_lines.BAD.search(fields[1]) or not raw_lines.FULL.search(fields[1]):
        return None
    return tuple(fields)


@settings(max_examples=300)
@given(st.lists(st.text(alphabet='"\t1a é \x01', max_size=200), max_size=6), st.integers(0, 150))
def test_automaton_against_plain_parser(lines, pad):
    lines = [*lines, *("1\t" + "z" * pad + x for x in lines)]
    assert [(r[1], r[2]) if r[0] else None for r in raw_lines.tokenize(lines)] == [plain_parse(x) for x in lines]


def test_no_lines(spark):
    assert check(spark, []) == []
