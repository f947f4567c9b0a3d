import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import text_types as tt

PROSE = [
    "The price of the lamp is high, and it is one of the reasons that most people do not buy it.", "to save water start with the small valve and then move to the large one since it is the first that leaks when it is cold",
    "THIS IS THE WAY TO OPEN THE BOX, AND IT IS NOT HARD FOR THE READER OF THE BOOK.", "Heading\n- item one\n- item two\nIf the door is shut, the guard opens it with the key of the house.", "At 3:2 the pump was at 5 V, 7 A and 20 °C, and the filter was open. It is 3 x 4 x 5 mm.",
]
OTHER = [
    "• major lamp\n• smooth motor (25)\n• gentle platform\n• thick region\n• panel", "Name   Size   Rate\nlamp   21%    67.5\npump   152    4\nvalve  39%    -", "| a | 4% | 94% |\n| b | - | 79% |\n| c | 2 | 5 |", "Home | About | Cart | Search | News",
    "How to open the box\nHow to shut the door\nHow to start the pump\nHow to move the lamp", "best lamp near me cheap lamp lamp store lamp near me best lamp lamp price lamp", "#(2) #column #valve #pump", "--- == ~~ >>> && $$ ---", "x" * 80, "4f 9a de 00 12 aa\n55 de ff 01 9c 3b",
]


@pytest.fixture(scope="module")
def words(spark):
    en = "the of and to in is for with that it on as are was not if one most do when how then since this"
    return spark.createDataFrame([("en", w) for w in en.split()] + [("ru", "и"), (None, "q")], "lang string, word string")


def test_types(spark, words):
    texts = [*PROSE * 12, *OTHER * 2]
    data = [(i, f"{t}") for i, t in enumerate(texts)] + [(500, None), (501, " \n\t"), (502, ""), (503, PROSE[0] + " word" * 40_000), (None, PROSE[0])]
    df = spark.createDataFrame(data, "doc_id bigint, passage_text string").withColumn("type", F.lit(1)).withColumn("length", F.lit("z")).withColumn("pattern", F.lit(0))
    lengths = spark.createDataFrame([(i, len(t.split()), 1) for i, t in enumerate(texts)] + [(0, 3, 0), (1, None, 0)], "doc_id bigint, length bigint, written_at int").withColumn("type", F.lit(2))
    got = {r["doc_id"]: r["type"] for r in tt.text_types(df, lengths, words).collect()}
    assert set(got) == {*range(len(texts)), 503, None}
    wrong = [texts[i] for i, t in got.items() if i is not None and i < len(texts) and (t == "prose") != (texts[i] in PROSE)]
    assert not wrong
    assert tt.text_types(df.where("false"), lengths, words).count() == 0
    assert tt.text_types(df, lengths.where("false"), words).count() == len(texts) + 2


K = len(tt.FUNCTIONS)


def planted(accuracy, prior, n=6000, seed=1):
    """Counts of patterns and the types behind them, from votes with the given probabilities: types x functions x votes."""
    rng = np.random.default_rng(seed)
    kinds = rng.choice(len(tt.TYPES), size=n, p=prior)
    counts, truth = {}, {}
    for t in kinds.tolist():
        p = sum(int(rng.choice(3, p=accuracy[t][j])) * 3**j for j in range(K))
        counts[p] = counts.get(p, 0) + 1
        truth.setdefault(p, []).append(t)
    return counts, truth


def usual():
    """Each function says what is right, most of the time."""
    acc = np.full((4, K, 3), 0.15)
    for i, t in enumerate(tt.TYPES):
        for j, says in enumerate(tt.FUNCTIONS.values()):
            for v, types in enumerate(says):
                acc[i, j, v] = 0.8 if t in types else 0.15
    return acc / acc.sum(axis=2, keepdims=True)


def wrong(post, truth):
    return sum((post[p].argmax() == 0) != (t == 0) for p, ts in truth.items() for t in ts) / sum(map(len, truth.values()))


def test_learning_recovers_accuracies():
    acc = usual()
    counts, truth = planted(acc, [0.7, 0.1, 0.1, 0.1])
    model = tt.learn(counts)
    sure = {p: np.array([prior * np.prod([acc[t, j, p // 3**j % 3] for j in range(K)]) for t, prior in enumerate((0.7, 0.1, 0.1, 0.1))]) for p in counts}
    assert wrong(model.posterior, truth) < wrong(sure, truth) + 0.01 and np.abs(model.accuracy[0] - acc[0]).max() < 0.06 and abs(model.prior[0] - 0.7) < 0.05
    assert all(abs(q.sum() - 1) < 1e-9 for q in model.posterior.values()) and tt.learn({}).posterior == {}


def test_accuracies_decide():
    """Functions that guess are found out: the types differ from the majority's, and are right more often."""
    acc = usual()
    names = list(tt.FUNCTIONS)
    for f in ("long_segment", "clause_word", "short_lines", "figures"):
        acc[:, names.index(f)] = (0.5, 0.0, 0.5)
    counts, truth = planted(acc, [0.7, 0.1, 0.1, 0.1])
    first = dict(zip(sorted(counts), tt.majority(np.array([[p // 3**j % 3 for j in range(K)] for p in sorted(counts)])), strict=True))
    model = tt.learn(counts)
    assert wrong(model.posterior, truth) < 0.5 * wrong(first, truth)
    assert any((model.posterior[p].argmax() == 0) != (first[p].argmax() == 0) for p in counts)
    assert np.abs(model.accuracy[0, names.index("clause_word")] - (0.5, 0, 0.5)).max() < 0.08


def test_published_accuracies(spark, words):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*PROSE * 12, *OTHER * 2])], "doc_id bigint, passage_text string")
    got = tt.accuracies(df, spark.createDataFrame([], "doc_id bigint, length bigint, written_at int"), words).collect()
    assert len(got) == 4 * K and all(abs(r["against"] + r["neither"] + r["for"] - 1) < 1e-9 for r in got)
    assert {r["type"]: r["share"] for r in got}["prose"] > 0.6


def test_dictionaries_come_from_all_texts(spark, words):
    """A wording that stands in short texts alone tells how a garbled text reads, whatever the partitions."""
    clean = [(i, f"the lamp, it’s old {w}") for i, w in enumerate(["red", "big", "new"] * 40)]
    df = spark.createDataFrame([*clean, (900, "the lamp, itÕs old red")], "doc_id bigint, passage_text string")
    more = words.union(spark.createDataFrame([("en", "it’s")], "lang string, word string"))
    for parts in (1, 3):
        got = {r["doc_id"]: r["common_words"] for r in tt.text_statistics(df.repartition(parts), more).collect()}
        assert len(got) == 121 and got[0] == got[900] == 2 / 5
