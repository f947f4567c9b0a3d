"""Text that was decoded with the wrong character encoding: detection and repair by minimum description length.

A passage is cut into sentences. For a sentence with suspicious characters every chain of decodings that could have garbled it is undone
where that is possible without error; the sentence as it stands and each result are compressed with a zstandard dictionary per language, and
the shortest description wins, where a chain adds its own cost. If no chain wins, the sentence stays unchanged.
"""

from __future__ import annotations

import base64
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from dataclasses import dataclass, field

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.storage import cut, dealt

DICT_BYTES = 32 << 10
UNIT_WORDS, WORD_CHARS = 4, 64  # of a unit that is counted; longer runs make several units
DICT_UNITS = DICT_BYTES  # units that a dictionary is made of: a byte each, more than it holds
SPELLED = 300_000  # units of the text that a dictionary is trained on, which has them in proportion to their counts
HELD = 200_000  # different units that a task counts before it passes counts on, and words whose marks it remembers
# Single-byte code pages that UTF-8 is misread with; undefined bytes stand for themselves.
PAGES = ("cp1252", "latin-1", "cp437", "cp850", "cp1250", "cp1251", "mac_roman", "cp866", "koi8_r", "cp852", "mac_cyrillic", "iso8859_5", "cp1253", "cp1254", "iso8859_15")
MULTI = ("shift_jis", "gbk", "big5", "euc_kr", "euc_jp")
# Pairs of (read as, really is) of single-byte pages taken for each other.
CROSSED = (
    ("cp1252", "cp1251"), ("cp1251", "cp1252"), ("cp1252", "koi8_r"), ("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("cp1252", "cp866"), ("cp1251", "cp866"), ("cp866", "cp1251"), ("mac_roman", "cp1252"), ("cp1252", "mac_roman"),
    ("cp437", "cp1252"), ("cp1252", "cp437"), ("cp850", "cp1252"), ("cp1252", "cp850"), ("mac_cyrillic", "cp1251"), ("cp1251", "mac_cyrillic"), ("mac_roman", "cp1251"), ("iso8859_5", "cp1251"), ("cp1251", "iso8859_5"), ("cp1250", "cp1252"),
)
COST = {"utf8": 0.25, "cross": 1.5, "utf16": 3.0, "utf7": 0.5}  # bytes
AGAIN = 0.75  # bytes that a chain costs less after it was used in the same text
MAX_WORDS = 100_000  # rows of common words
BEAM = 4  # chains that go on after each decoding, the shortest descriptions
RAW = 0.25  # bytes for each byte of plain length


def _table(page: str) -> dict[int, str]:
    """Characters of a page to the characters that have its byte's number."""
    table = {}
    for b in range(128, 256):
        try:
            ch = bytes([b]).decode(page)
        except UnicodeDecodeError:
            ch = chr(b)
        table[ord(ch)] = chr(b)
    for b in range(128, 160):  # bytes that came through as control characters
        table.setdefault(b, chr(b))
    if page in ("cp1252", "latin-1", "cp1254", "iso8859_15", "cp1250", "cp1253", "cp1251"):
        table.setdefault(0xA0, "\xa0")
    return table


TABLES = {p: _table(p) for p in PAGES}
_KNOWN = {p: {chr(k) for k in t} for p, t in TABLES.items()}


def to_bytes(text: str, page: str) -> bytes | None:
    """The bytes that ``page`` reads as ``text``; None if there are none."""
    if page in MULTI:
        try:
            return text.encode(page)
        except UnicodeEncodeError:
            return None
    try:
        return text.translate(_STRICT[page]).encode("latin-1")
    except UnicodeEncodeError:
        return None


class _Strict(dict):
    def __missing__(self, k: int) -> str:
        return chr(k) if k < 128 else "￿"


_STRICT = {p: _Strict(t) for p, t in TABLES.items()}
PLAIN = re.compile("[\x00-\x7f\xa0-ÿĀ-ſƏˆ˜Α-ωЀ-џ‐-‧‰′″‹›⁄€№™−√≈≠≤≥∞←-↓─-▟■-◿♀-♯✓-✗ﬁﬂ]*")


def _cls(chars: Iterator[str]) -> str:
    return "[" + "".join(re.escape(c) for c in sorted(chars)) + "]"


def _pair(page: str) -> str:
    """The characters that begin a misread two-byte or three-byte sequence of a letter, sign or mark in use here."""
    by: dict[int, list[str]] = {}
    for k, v in TABLES[page].items():
        by.setdefault(ord(v), []).append(chr(k))
    of = lambda numbers: _cls(c for n in numbers for c in by.get(n, []))
    cont, lead = range(0x80, 0xC0), of([0xC2, 0xC3, 0xC4, 0xC5, 0xCB, 0xCE, 0xCF, 0xD0, 0xD1])
    two = lead + of(cont)
    if page == "koi8_r":
        two = f"(?<=[A-Za-z]){two}"  # the letter io may follow only where a Latin letter stands before
        cont = [n for n in cont if n not in (0xA3, 0xB3)]
        two += f"|{lead}{of(cont)}"
    three = of([0xE2]) + of([0x80, 0x81, 0x82, 0x84, 0x86, 0x88, 0x89, 0x94, 0x95, 0x96, 0x97]) + of(cont)
    return f"{two}|{three}"


PAIR = {p: re.compile(_pair(p)) for p in PAGES}
WIDE = r"\u2e80-\ua4cf\uac00-\ud7af\ue000-\uf8ff"
# words that can only come from one single-byte page taken for another
CROSS = re.compile(
    r"[A-Za-zÀ-ÿ][Ѐ-ӿ]|[Ѐ-ӿ][A-Za-zÀ-ÿ]|[ЂЃЄЅІЇЈЉЊЋЌЎЏђѓєѕіїјљњћќўџҐґ]|[а-яё][А-ЯЁ]|(?<![A-Za-zÀ-ÿ])[À-ÿ¸¨]{2,}(?![A-Za-zÀ-ÿ])|[A-Za-z][¨¸ˆ˜´¬…†‡•‰‹›¿¡º]+[a-z]|[a-z][ÈËŠÞÁÔÕÍÌŽ¸][a-z]|[A-Za-z][\u2500-\u259f\u2200-\u22ff][a-z]"
)
FOREIGN = re.compile("[ЂЃЄЅІЇЈЉЊЋЌЎЏђѓєѕіїјљњћќўџҐґ]")  # letters of none of the five languages
SUSPECT = re.compile(rf"�|[\x80-\x84\x86-\x9f]|[\uff61-\uff9f]|[{WIDE}]{{2}}|[{WIDE}][A-Za-z]|[A-Za-z][{WIDE}]|{CROSS.pattern}|" + "|".join(_pair(p) for p in PAGES))
# what clean text of the five languages does not have: found fast, and most texts end here
UNUSUAL = re.compile(
    "[^\x00-\x7fáéíóúñüÁÉÍÓÚÑÜ¿¡äöüßÄÖÜàâçèéêëîïôùûœÀÂÇÈÉÊËÎÏÔÙÛа-яА-ЯёЁ]|[áéíóúñüÁÉÍÓÚÑÜ¿¡äöüßÄÖÜàâçèéêëîïôùûœÀÂÇÈÉÊËÎÏÔÙÛ]{2}|[а-яё][А-ЯЁ]|[A-Za-zÀ-ÿ][а-яА-ЯёЁ]|[а-яА-ЯёЁ][A-Za-zÀ-ÿ]|[РСВГ]ё"
)
# what no right text of the five languages has, whether it can be restored or not: control characters, or misread pairs one after another
CERTAIN = re.compile("[\x80-\x84\x86-\x9f]|" + "|".join(f"(?:{_pair(p)}){{3}}" for p in PAGES))
UTF7 = re.compile(r"\+([A-Za-z0-9+/]{3,})(-?)")
SENTENCE = re.compile(r"(?<=[.!?])(\s+)|(\n+)")
RUN = re.compile("[^\x00-\x7f]+")
WIDE_RUN = re.compile("[^\x00-\x7f]{4,}")


def undo_utf8(text: str, page: str, parts: bool) -> str | None:
    """``text`` with its runs of other than ASCII characters read as UTF-8; with ``parts``, those runs that can be, else all or none."""
    done = 0

    def fix(m: re.Match) -> str:
        nonlocal done
        b = to_bytes(m[0], page)
        if b is not None:
            try:
                out = b.decode("utf-8")
                if PLAIN.fullmatch(out) or page == "cp1252":
                    done += 1
                    return out
            except UnicodeDecodeError:
                pass
        if not parts:
            raise ValueError
        return m[0]

    try:
        out = RUN.sub(fix, text)
    except ValueError:
        return None
    return out if done and out != text else None


def undo_utf7(text: str) -> str | None:
    def fix(m: re.Match) -> str:
        for n in range(len(m[1]), 2, -1):  # the closing hyphen is left out before other characters
            if n < len(m[1]) and m[2]:
                break
            body = m[1][:n]
            if n % 8 not in (0, 3, 6):
                continue
            raw = base64.b64decode(body + "=" * (-n % 4))
            raw = raw[: len(raw) // 2 * 2]
            if base64.b64encode(raw).decode().rstrip("=") != body:
                continue
            try:
                out = raw.decode("utf-16-be")
            except UnicodeDecodeError:
                continue
            if out and PLAIN.fullmatch(out) and not out.isascii() and out.isprintable():
                return out + (m[1][n:] + m[2] if n < len(m[1]) else "")
        return m[0]

    out = UTF7.sub(fix, text)
    return out if out != text else None


def undo_utf16(text: str) -> str | None:
    """Runs of characters whose two bytes were swapped."""

    def fix(m: re.Match) -> str:
        try:
            out = m[0].encode("utf-16-le").decode("utf-16-be")
        except UnicodeError:
            return m[0]
        return out if PLAIN.fullmatch(out) else m[0]

    out = WIDE_RUN.sub(fix, text)
    return out if out != text else None


def chains(text: str) -> Iterator[tuple[str, float, str]]:
    """``(name, cost, result)`` of each single decoding that can be undone."""
    if text.isascii():
        if (out := undo_utf7(text)) is not None:
            yield "utf-7", COST["utf7"], out
        return
    wide = max(text) >= "\u2e80"
    for page in PAGES:
        if PAIR[page].search(text):
            whole = undo_utf8(text, page, False)
            if whole is not None:
                yield f"utf-8<{page}", COST["utf8"], whole
            elif (out := undo_utf8(text, page, True)) is not None:
                yield f"utf-8<{page}", COST["utf8"] + 1, out
    if wide:
        for page in MULTI:
            whole = undo_utf8(text, page, False)
            if whole is None:
                whole = undo_utf8(text, page, True)
            if whole is not None:
                yield f"utf-8<{page}", COST["utf8"] + 1, whole
        if (out := undo_utf16(text)) is not None:
            yield "utf-16 swapped", COST["utf16"], out
    for read, real in CROSSED if CROSS.search(text) else ():
        b = to_bytes(text, read)
        if b is not None:
            try:
                out = b.decode(real)
            except UnicodeDecodeError:
                continue
            if out != text and PLAIN.fullmatch(out) and sum(map(str.isalpha, out)) >= sum(map(str.isalpha, FOREIGN.sub("", text))) - 1:
                yield f"{real}<{read}", (0.0 if FOREIGN.search(text) else COST["cross"]) + float((read, real) not in CROSSED[:2]), out
    if "+" in text and (out := undo_utf7(text)) is not None:
        yield "utf-7", COST["utf7"], out


@dataclass
class Describer:
    """Description lengths under per-language dictionaries."""

    dictionaries: dict[str, bytes]
    _coders: list = field(default_factory=list, repr=False)

    def __getstate__(self) -> dict:
        return {"dictionaries": self.dictionaries, "_coders": []}

    def length(self, text: str) -> float:
        """Bytes of the shortest description; the plain length breaks the ties of whole bytes."""
        if not self._coders:
            for raw in self.dictionaries.values():
                d = zstandard.ZstdCompressionDict(raw)
                self._coders.append(zstandard.ZstdCompressor(level=3, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
            if not self._coders:
                self._coders.append(zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False))
        data = text.encode("utf-8", "surrogatepass")
        return min(len(c.compress(data)) for c in self._coders) + len(data) * RAW


def restore(text: str, describer: Describer, depth: int = 3) -> tuple[str, list[str]]:
    """The text with its garbled sentences restored and the chains that were undone.

    Of up to ``depth`` decodings, each goes on from the BEAM best results of the one before, so a chain may begin with a step that is not
    the best alone.
    """
    if "+" not in text and not suspicious(text):
        return text, []
    return _restore(text, describer, depth)


_MARKS: dict[str, int] = {}  # words that a pattern matches: 1 UNUSUAL, 2 SUSPECT
_PLAIN: set[str] = set()  # words that none does


def suspicious(text: str) -> bool:
    """Whether something in the text may be garbled, UTF-7 apart. What is certainly garbled (CERTAIN) is suspicious.

    No match of either pattern holds or needs a space, so each word is searched once and then remembered.
    """
    if text.isascii():
        return False
    marks = 0
    for w in set(text.split(" ")).difference(_PLAIN):
        found = _MARKS.get(w)
        if found is None:
            found = 0 if w.isascii() else bool(UNUSUAL.search(w)) | bool(SUSPECT.search(w)) << 1
            if len(w) <= WORD_CHARS:
                if len(_PLAIN) + len(_MARKS) >= HELD:
                    _PLAIN.clear()
                    _MARKS.clear()
                if found:
                    _MARKS[w] = found
                else:
                    _PLAIN.add(w)
        marks |= found
        if marks == 3:
            return True
    return False


def _restore(text: str, describer: Describer, depth: int = 3) -> tuple[str, list[str]]:
    out, used, at = [], [], 0
    bounds = [(m.start(), m.end()) for m in SENTENCE.finditer(text)] + [(len(text), len(text))]
    for end, after in bounds:
        unit, gap = text[at:end], text[end:after]
        at = after
        if unit and (SUSPECT.search(unit) or UTF7.search(unit)):
            best, cost, names = unit, float(describer.length(unit)), []
            open_: list[tuple[float, float, list[str], str]] = [(cost, 0.0, [], unit)]  # description, cost of the chain, chain, text
            seen = {unit}
            for _ in range(depth):
                tried = []
                for _, paid, path, now in open_:
                    for name, c, x in chains(now):
                        if x not in seen:
                            seen.add(x)
                            spent = paid + c
                            tried.append((describer.length(x) + spent - AGAIN * (name in used), spent, [*path, name], x))
                tried.sort()
                if tried and tried[0][0] < cost:
                    cost, _, names, best = tried[0]
                open_ = [t for t in tried[:BEAM] if SUSPECT.search(t[3]) or UTF7.search(t[3])]
                if not open_:
                    break
            unit = best
            used += names
        out += [unit, gap]
    return "".join(out), used


def few_rows(df: DataFrame, most: int) -> list:
    """The rows of a table that must be small; more than ``most`` raise ValueError."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    return rows


def few_words(common_words: DataFrame) -> dict[str, list[str]]:
    """The frequent words of each language."""
    common: dict[str, list[str]] = {}
    for r in few_rows(common_words.where("lang is not null and word is not null"), MAX_WORDS):
        common.setdefault(r["lang"], []).append(r["word"])
    return common


class Counts:
    """How often each unit stands in texts of each language: up to UNIT_WORDS words, of which all but the last are frequent ones.

    The units of a text follow one another and make up the whole of it. A text's language is that with most of its frequent words in it; a text with
    less than a tenth of such words has none and is not counted.
    """

    def __init__(self, common: dict[str, list[str]]) -> None:
        self.names = sorted(common)
        forms = {k: {form for w in common[k] for form in (w, w.lower(), w.capitalize(), w.upper())} for k in self.names}
        # the languages of a word as a string, which is faster to count than a tuple
        self.langs = {w: " ".join(str(i) for i, k in enumerate(self.names) if w in forms[k]) for w in set().union(*forms.values())}
        self.counts: dict[str, Counter[str]] = {}

    def add(self, text: str) -> bool:
        """Count a text and return True; False, and nothing is counted, if something in it may be garbled."""
        if suspicious(text) or "+" in text and UTF7.search(text):
            return False
        words = text.split()
        if not words:
            return True
        langs = list(map(self.langs.get, words))
        score = dict.fromkeys(self.names, 0)
        for ks, n in Counter(langs).items():
            for k in ks.split() if ks else ():
                score[self.names[int(k)]] += n
        lang = max(score, key=score.get) if score else "any"
        if not score or score[lang] * 10 >= len(words):
            self.counts.setdefault(lang, Counter()).update(self.units(words, langs))
        return True

    def units(self, words: list[str], langs: list[str | None]) -> list[str]:
        """The words, of which frequent ones have languages, joined into units."""
        ends = [i for i, k in enumerate(langs, 1) if k is None]
        if not ends or ends[-1] < len(words):  # frequent words end the text
            ends.append(len(words))
        out, at = [], 0
        for end in ends:
            while end - at > UNIT_WORDS:
                out.append(" ".join(words[at : at + UNIT_WORDS]))
                at += UNIT_WORDS
            out.append(" ".join(words[at:end]) if end - at > 1 else words[at])
            at = end
        return out

    def take(self, least: int = 0) -> list[tuple[str, str, int]]:
        """``(language, unit, count)`` of what was counted since the last call, once it is more than ``least`` units; words beyond WORD_CHARS in pieces."""
        if sum(map(len, self.counts.values())) <= least:
            return []
        out = [(k, u, n) for k, c in self.counts.items() for u, n in c.items()]
        self.counts = {}
        if any(len(u) > WORD_CHARS for _, u, _ in out):
            out = [(k, u[i : i + WORD_CHARS], n) for k, u, n in out for i in range(0, len(u), WORD_CHARS)]
        return out


def describer(counts: DataFrame, langs: list[str]) -> Describer:
    """Dictionaries of the units ``(lang, unit, n)`` that were counted over all texts, parts of counts included.

    All counts are added up; of each language the DICT_UNITS units that hold most of its text come to the driver.
    """
    totals = cut(counts.groupBy("lang", "unit").agg(F.sum("n").alias("n")))
    held = (F.col("n") * (F.octet_length("unit") + 1)).desc()
    best = [totals.where(F.col("lang") == k).orderBy(held, "unit").limit(DICT_UNITS) for k in langs or ["any"]]
    units: dict[str, list[tuple[str, int]]] = {}
    for r in cut(reduce(DataFrame.unionByName, best)).collect():
        units.setdefault(r["lang"], []).append((r["unit"], r["n"]))
    dictionaries = {k: _dictionary([x.encode("utf-8") for x in spelled(v)]) for k, v in sorted(units.items())}
    return Describer({k: v for k, v in dictionaries.items() if v})


def spelled(units: list[tuple[str, int]]) -> list[str]:
    """Lines of 12 units in which each unit stands in proportion to its count, evenly mixed."""
    share = min(1.0, SPELLED / max(1, sum(n for _, n in units)))
    at = []
    for u, n in units:
        times = max(1, round(n * share))
        at += [((j + 0.5) / times, u) for j in range(times)]
    mixed = [u for _, u in sorted(at)]
    step = len(mixed) // 12 + 1
    return [" ".join(mixed[i::step]) for i in range(min(step, len(mixed)))]


def _dictionary(data: list[bytes]) -> bytes:
    """A trained dictionary; too few texts are one themselves."""
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, max(1024, sum(map(len, data)) // 8)), data).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(data)[:DICT_BYTES]


def train(sentences: dict[str, list[str]]) -> Describer:
    """A dictionary per language; languages with too few sentences get their text itself as one."""
    dictionaries = {lang: _dictionary([t.encode("utf-8") for t in sorted(set(texts))]) for lang, texts in sorted(sentences.items())}
    return Describer({k: v for k, v in dictionaries.items() if v})


def restored(table: DataFrame, common_words: DataFrame, id_col: str = "doc_id", text_col: str = "passage_text") -> DataFrame:
    """``(id, restored, chains, complete)``, a row for each text that is garbled somewhere.

    restored is the text with every sentence put right that could be, chains the decodings undone, in order and joined by ", ".
    complete is false if replacement characters are left, whose originals are lost, or stretches that are certainly garbled but that no chain restores. Null and empty texts, and texts that are right as they stand,
    give no row; repeated rows give repeated rows; other columns are ignored; an empty table gives no rows. One pass counts the units of all texts that
    nothing in is garbled and sets the others aside, which wait for the dictionaries.
    """
    given = few_words(common_words)
    sc = table.sparkSession.sparkContext
    words = sc.broadcast(given)
    fields = [("id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("unit", pa.string()), ("n", pa.int64())]

    def batch(rows: list[tuple], kinds: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, kinds, strict=True)], names=[n for n, _ in kinds])

    def first(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(words.value)
        for b in it:
            rows: list[tuple] = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if t and (not counts.add(t) or "+" in t):
                    rows.append((i, t, None, None, None))
            yield batch([*rows, *((None, None, *x) for x in counts.take(HELD))], fields)
        yield batch([(None, None, *x) for x in counts.take()], fields)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = learned.value
        for b in it:
            rows: list[tuple] = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                out, used = _restore(t, d)
                lost = "�" in out or bool(UNUSUAL.search(out) and CERTAIN.search(out))
                if used or lost:
                    rows.append((i, out, ", ".join(dict.fromkeys(used)), not lost))
            yield batch(rows, [("id", pa.int64()), ("restored", pa.string()), ("chains", pa.string()), ("complete", pa.bool_())])

    picked = table.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    seen = cut(picked.mapInArrow(first, "id bigint, text string, lang string, unit string, n bigint"))
    learned = sc.broadcast(describer(seen.where("unit is not null").select("lang", "unit", "n"), sorted(given)))  # dictionaries of DICT_BYTES for each language
    aside = dealt(seen.where("text is not null").select("id", "text"))
    return aside.mapInArrow(run, "id bigint, restored string, chains string, complete boolean")
