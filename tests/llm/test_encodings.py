import pytest
from conftest import DATA, rows
from pyspark.sql import functions as F

from lodestone.llm import encodings as enc

CLEAN = {
    "en": ["The café in the square keeps the storage at 20 °C – that’s a usual summary for the answer.", "It isn’t a central point — it’s a piñata of the farm and the server.", "The price is £20 … or about €10 for the branch’s tunnel.", "The boat of the town is in the harbor, and it is one of the forms in use."],
    "de": ["Für die Prüfung sind etwa 53 Tage nötig, und der Bericht hängt von der Größe der Bäume ab.", "Man schätzt die Maße für das Gerät auf der Straße.", "Die Größe der Häuser hängt von dem Gebäude ab."],
    "fr": ["Pour la journée, il faut 20 jours, et le résumé complète la réponse déjà préparée.", "C’est le théâtre qui a été fermé à l’été.", "Le château est très élevé, mais il ne protège pas la forêt."],
    "es": ["Para la edición se necesitan 11 días, y el número es también más rápido.", "¿Qué es un jardín? Es la región más cálida que hay según el título.", "La canción de otoño fue escrita por la niña."],
    "ru": ["При этом лесной дом из города был построен только в году, но также и для людей.", "Это новая книга, что была на столе и для детей.", "Река и море в городе не были такими."],
}


@pytest.fixture(scope="module")
def describer():
    return enc.train({k: [f"{s} {i}" for s in v for i in range(12)] for k, v in CLEAN.items()})


def misread(text, page):
    return "".join(bytes([b]).decode(page) if _ok(b, page) else chr(b) for b in text.encode("utf-8"))


def _ok(b, page):
    try:
        bytes([b]).decode(page)
        return True
    except UnicodeDecodeError:
        return False


@pytest.mark.parametrize("page", ["cp1252", "latin-1", "cp437", "cp850", "cp1250", "cp1251", "mac_roman"])
@pytest.mark.parametrize("lang", ["en", "de", "fr", "es"])
def test_utf8_misread_is_undone(describer, lang, page):
    for s in CLEAN[lang]:
        bad = misread(s, page)
        if bad != s:
            assert enc.restore(bad, describer)[0] == s


def test_other_chains(describer):
    ru, fr, en = CLEAN["ru"][0], CLEAN["fr"][0], CLEAN["en"][1]
    assert enc.restore(ru.encode("cp1251").decode("cp1252"), describer)[0] == ru
    assert enc.restore(fr.encode("cp1252").decode("cp1251"), describer)[0] == fr
    assert enc.restore(misread(misread(en, "cp1252"), "cp1252"), describer)[0] == en
    assert enc.restore(en.encode("utf-7").decode("ascii"), describer)[0] == en
    assert enc.restore(ru.encode("utf-7").decode("ascii"), describer)[0] == ru
    swapped = en.encode("utf-16-le").decode("utf-16-be", "surrogatepass")
    assert enc.restore(swapped, describer)[0] == en


def test_chains_whose_first_step_is_not_the_best_alone(describer, monkeypatch):
    for lang, at, first, then in (("de", 0, "mac_roman", "cp437"), ("en", 2, "latin-1", "cp1251"), ("en", 0, "koi8_r", "mac_roman")):
        s = CLEAN[lang][at]
        bad = misread(misread(s, first), then)
        monkeypatch.setattr(enc, "BEAM", 1)
        assert enc.restore(bad, describer)[0] != s
        monkeypatch.setattr(enc, "BEAM", 4)
        assert enc.restore(bad, describer)[0] == s


def test_only_the_garbled_sentence_changes(describer):
    good, bad = CLEAN["es"][0], CLEAN["es"][2]
    got, used = enc.restore(f"{good} {misread(bad, 'cp1252')}", describer)
    assert got == f"{good} {bad}" and used == ["utf-8<cp1252"]


@pytest.mark.parametrize("lang", list(CLEAN))
def test_clean_text_stays(describer, lang):
    for s in [*CLEAN[lang], *(x.upper() for x in CLEAN[lang])]:
        assert enc.restore(s, describer) == (s, [])


def test_rare_letters_stay(describer):
    for s in ("The town of SÃO Paulo is here.", "The sign reads «ÂGE D’OR» and stays.", "Sold in Łódźeń and Þórvik.", "The mark 茶 is for tea.", "The angle α is 3, and Δ3 is 4 µm ± 2.", "GARÇÃO & FILHAS®", "├── a\n│   └── b", "a+b=c and 1+2345 = 7", "naïve résumé", "Ёлка и Рёва стоят в лесу."):
        assert enc.restore(s, describer) == (s, [])


def test_table(spark):
    words = spark.createDataFrame([("en", "the"), ("en", "is"), ("es", "de"), (None, "x")], "lang string, word string")
    clean = [(i, s) for i, s in enumerate(x for v in CLEAN.values() for x in v)]
    data = [*clean, (100, "The cafÃ© is open."), (100, "The cafÃ© is open."), (101, "Caf� was lost."), (102, None), (103, ""), (104, "plain " * 30_000 + "cafÃ©"), (None, "The cafÃ© is shut.")]
    df = spark.createDataFrame(data, "doc_id bigint, passage_text string").withColumn("restored", F.lit(1)).withColumn("id", F.lit(2))
    got = rows(enc.restored(df, words))
    assert [(r[0], r[3]) for r in got] == [(100, True), (100, True), (101, False), (104, True), (None, True)]
    assert got[0][1] == "The café is open." and got[3][1].endswith("café")
    assert enc.restored(df.where("false"), words).count() == 0 and enc.restored(df, words.where("false")).count() == 5


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
def test_restoring_is_final(spark):
    from lodestone.llm import registry

    out = registry.QUERIES["p2_restored"](spark, str(DATA)).where("complete")
    again = enc.restored(out.select("doc_id", F.col("restored").alias("passage_text")), spark.read.parquet(f"{DATA}/common_words.parquet"))
    assert out.count() > 3 and again.count() <= 0.1 * out.count()


@pytest.mark.parametrize("page", ["cp1251", "cp866", "koi8_r", "mac_cyrillic", "iso8859_5"])
def test_a_garbled_stretch_beside_right_letters(describer, page):
    for lang, at in (("ru", 3), ("de", 0), ("fr", 3), ("es", 2)):
        s = CLEAN[lang][0]
        words = s.split(" ")
        k = next(i for i, w in enumerate(words) if i >= at and not w.isascii())
        bad = " ".join([*words[:k], misread(words[k], page), *words[k + 1 :]])
        rest = " ".join(words[k + 1 :])
        assert bad != s and not rest.isascii()
        got, used = enc.restore(bad, describer)
        assert got == s and len(used) == 1, (lang, bad, got, used)  # several pages may read the stretch alike


def test_certain_stretches_are_reported_unrestored(spark):
    text = "Plain words with \x9d\x81 of unknown origin stand here."
    df = spark.createDataFrame([(1, text), (2, CLEAN["ru"][0]), (3, "Größe und Maß, «été», ¿qué?")], "doc_id bigint, passage_text string")
    words = spark.createDataFrame([("en", "the")], "lang string, word string")
    assert rows(enc.restored(df, words)) == [(1, text, "", False)]


def test_dictionaries_come_from_all_texts(spark):
    """Every text is counted, and a wording that stands in short texts alone tells how a garbled text reads, whatever the partitions."""
    clean = [(i, f"the lamp, it’s old {w}") for i, w in enumerate(["red", "big", "new"] * 40)]
    df = spark.createDataFrame([*clean, (900, "the lamp, itÕs old red")], "doc_id bigint, passage_text string")
    words = spark.createDataFrame([("en", "the"), ("en", "it’s")], "lang string, word string")
    for parts in (1, 3):
        assert rows(enc.restored(df.repartition(parts), words)) == [(900, "the lamp, it’s old red", "mac_roman<cp1252", True)]


def test_counts_are_whole():
    counts = enc.Counts({"en": ["the", "of"], "de": ["der"]})
    texts = ["The lamp of the house", "the of the of the of", "der Turm", "x" * 150 + " the", "the cafÃ© of it", "no frequent word in here at all, none in a dozen words", "", " "]
    assert [counts.add(t) for t in texts] == [True] * 4 + [False] + [True] * 3
    got = sorted(counts.take())
    assert got == sorted([("en", "The lamp", 1), ("en", "of the house", 1), ("en", "the of the of", 1), ("en", "the of", 1), ("de", "der Turm", 1), ("en", "x" * 64, 1), ("en", "x" * 64, 1), ("en", "x" * 22, 1), ("en", "the", 1)])
    assert counts.take() == []
