import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from lodestone.llm import templates as t

SURE = ["Dear {{name}}, hello.", "Dear {$date},", "Hi ${first name}!", "Title: [insert City here]", "By <%= year %>", "Tags: (enter user), <insert title>", "A [%company%] of %(user)s", "on XX_company_XX", "at @@email@@ now", "<?= $City ?>", "{{ first name | default }}", "Dear {{ }},", "by <%= %> today"]
OTHER_DELIMITERS = ["Bonjour __COMPANY__,", "on [[Address]] today", "by &lt;User&gt;", "in ##city##", "pay %price% now", "{section heading}", "Dear [NAME],", "to <EMAIL> now", "for $amount$ only"]
QUOTED = ['The mark "{{titre}}" stands for the reader.', "A template engine reads “${email}” as a field, while `@@name@@` is left alone.", "Authors write ‘[[Date]]’ where the author belongs."]
NO_SPANS = ["It costs 5% (see 58.6) or [160].", "growth of 15% and 20% in all", "if (a < b) then # of it"]


@pytest.mark.parametrize("text", SURE)
def test_sure_delimiters(text):
    found = [s for s in t.slots(text) if not s[3]]
    assert found and any(s[0] == "blank" or s[0] in t.SHAPES and t.SHAPES[s[0]][1] for s in found)


@pytest.mark.parametrize("text", OTHER_DELIMITERS)
def test_other_delimiters(text):
    assert [s for s in t.slots(text) if not s[3] and s[1]]


@pytest.mark.parametrize("text", [*QUOTED, *NO_SPANS])
def test_quoted_or_no_placeholders(text):
    assert not [s for s in t.slots(text) if not s[3]]


def frame(spark, texts, first=0, site=None):
    return spark.createDataFrame([(first + i, x, site or f"site{i}") for i, x in enumerate(texts)], "doc_id bigint, text string, site string")


def found(df, **kw):
    return {r["id"]: r["reason"] for r in t.template_residue(df, site_col="site", **kw).collect()}


def test_names_are_learned(spark):
    """Names that stand between sure delimiters make slots of other delimiters that mostly hold such names."""
    texts = ["Dear {{gizmo}}, hello.", "We ship to <%= harbour %> soon.", "Dear [GIZMO], hello again.", "The [harbour] is closed now.", "A <gizmo> and a <lamp> stand here.", "See <pump> and <valve> in the hall.", "It is {set} in stone."]
    assert found(frame(spark, texts)) == {i: "placeholder" for i in (0, 1, 2, 3)}  # most spans in < > hold other words


def test_names_in_several_forms(spark):
    texts = [f"We thank [[widget]] for {w} and more." for w in ("tea", "ink")] + [f"See ##widget## on {w} and more." for w in ("air", "sea")] + ["A {thing} once in a text."]
    assert set(found(frame(spark, texts))) == {0, 1, 2, 3}


ERRORS = {
    "Der Dienst ruht gerade. Vorgang {a}.": 5, "Nuk u gjet asgjë në këtë adresë.": 4, "The gate for /x/{b}/y is shut at the moment ({a}).": 4, "Wartung\nVorgang {a}\nBitte kommen Sie wieder": 6, "Skriptet duhen lejuar. Ringarkoni faqen.": 3,
}


def pages(rng):
    out = [text.replace("{a}", str(rng.randrange(10_000))).replace("{b}", rng.choice(["a", "bc", "d1"])) for text, n in ERRORS.items() for _ in range(n)]
    words = [f"w{c}{d}" for c in "abcdefgh" for d in "klmnop"]
    out += [f"Fehler beim Laden von {w} im Werk\nBitte kommen Sie wieder" for w in words[:8]]  # a word differs
    out += ["lorem ipsum dolor sit amet consectetur.", "dolor amet lorem elit sed ipsum.", "qz qz qz qz qz qz qz qz", "blurb\nblurb\nblurb\nblurb\nblurb."]
    return out


def prose(rng, n):
    words = "lamp pump valve river stone cloud house door hall reader price water garden letter winter train".split()
    return [" ".join(f"The {rng.choice(words)} of the {rng.choice(words)} is near the {rng.choice(words)} {rng.randrange(100)}{c}." for c in "abc") for _ in range(n)]


def test_pages_in_wordings_that_no_list_knows(spark):
    rng = random.Random(1)
    bad, good = pages(rng), prose(rng, 60)
    good += [f"Skriptet duhen lejuar. Ringarkoni faqen.\n{x}" for x in prose(rng, 5)]  # real texts below a notice
    good += [f"lamp\n{w} pump\nvalve and {w} reactors\n{i}" for i, w in enumerate(("red", "blue", "old"))] + [f"{i}\n{i * 7} {i}" for i in range(5)]
    got = found(frame(spark, bad).union(frame(spark, good, 1000)))
    assert not [i for i in got if i >= 1000]
    assert len(got) >= 0.9 * len(bad) and set(got.values()) == {"page"}


def test_residue_does_not_depend_on_other_texts(spark):
    bad = frame(spark, [f"Wartungsfenster {i}" for i in range(5)], site="a").union(frame(spark, ["Lampenliste"] * 9, 10, "b")).union(frame(spark, ["Werkspause"] * 5, 30))
    other = spark.range(1000, 131_000).selectExpr("id as doc_id", "concat('The lamp ', id, 'x of the house is old and stands in the hall', id) as text", "'c' as site")
    got = [set(found(x)) for x in (bad, bad.union(other))]
    assert got[0] == {*range(5), *range(30, 35)}  # a page fetched again and again is no template
    assert {i for i in got[1] if i < 1000} == got[0]


def test_articles_on_several_sites_are_no_templates(spark):
    article = " ".join(f"Sentence {c} of the story tells of the {w}." for c, w in zip("abcdefghijklmnop", "lamp pump valve river stone cloud house door hall reader price water garden letter winter train".split(), strict=True))
    assert found(frame(spark, [article] * 6)) == {}


def test_furniture_stands_beside_real_texts(spark):
    rng = random.Random(2)
    real = [f"More of this\n{x}" for x in prose(rng, 8)]
    assert found(frame(spark, [*real, "More of this\nA lone line with nothing like it"])) == {}


def test_known_sentences(spark):
    df = frame(spark, ["Out of order.", "Out of order. The lamp is old."])
    assert found(df) == {} and found(df, known="^Out of order") == {0: "page"}


def test_special_cases(spark):
    texts = [None, "", " \n", "closed until May", "closed until May", "closed until May", "x " * 60_000 + "word {{name}} end"]
    df = frame(spark, texts).union(spark.createDataFrame([(None, "closed until May", "z"), (3, "Plain words on the lamp.", "z")], "doc_id bigint, text string, site string"))
    for c in ("id", "page", "u", "reason", "n", "name"):
        df = df.withColumn(c, F.lit("q"))
    got = rows(t.template_residue(df, site_col="site"))
    assert got == [(3, "page"), (4, "page"), (5, "page"), (6, "placeholder"), (None, "page")]
    kept = t.without_residue(df, site_col="site")
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {0, 1, 2, None}
    assert t.template_residue(df.where("false")).count() == 0


def test_slots_in_sentences_of_any_length(spark):
    """A word that differs is a slot also in a long sentence; one word left out, two sentences agree in that place alone."""
    start, end = " ".join(f"start{c}" for c in "abcdefghijklmnop"), " ".join(f"end{c}" for c in "abcdefghijklmnop")
    a, b = ({v for v, _ in t.with_slot(f"{start} {w} {end}")} for w in ("lamp", "pump"))
    assert len(a) == len(b) == 33 and len(a & b) == 1
    assert not a & {v for v, _ in t.with_slot(f"{end} lamp {start}")}
    assert len(t.with_slot(" ".join(f"lamp{i}" for i in range(100_000)))) == 100_000
    bad = [f"{start} {w} {end}\nBitte kommen Sie wieder" for w in ("lamp", "pump", "valve", "river", "stone", "cloud", "house", "door")]
    good = prose(random.Random(4), 20)
    assert found(frame(spark, [*bad, *good])) == dict.fromkeys(range(8), "page")
