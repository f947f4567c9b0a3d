"""Template residue: placeholders left unfilled, and pages that hold nothing but filler, an error or a notice.

Placeholders. Spans between delimiters are the slots that differ between records made from one template. Delimiters that template languages
alone use tell the variable names of the collection; a span between other mirrored delimiters is a slot if it still holds such a name, or a
name that fills slots of several frames or forms. Slots of the first kind are residue whatever they hold, also if they are left blank; slots in
quotation marks or backticks are being written about.

Pages. A page is cut into sentences, its furniture put aside. Their skeletons (numbers, paths, names and quoted strings become slots) are
aligned over all pages of the collection. A skeleton of several pages is a template's if these pages mostly hold nothing but such skeletons; short
ones that stand beside real text as well are furniture. Sentences of pages that are templates otherwise are aligned again with one word
left out, which induces the slots that skeletons do not show. A page is residue if all its sentences are templates', filler or furniture, and not
all of them furniture. No wording of errors or notices is known beforehand.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.skew import semi_join
from lodestone.operators.storage import cut

FILLER, SHORT = 1, 2
SHORT_WORDS = 6  # of a sentence that may be furniture
SLOT_ROWS = 100_000  # words left out that leave a task at a time, those of one sentence apart
TEMPLATE_SENTENCES = 12  # different ones of a page that is a template; more are an article that several sites carry

# Delimiters of template languages. "sure" forms have no other use in running text.
_NAME = r"[^\W\d_][\w]*(?:[ ._-][^\W\d_][\w]*){0,3}"
SHAPES = {
    "mustache": (r"\{\{\{?\s?[#/^&]?\s?(?P<n%d>" + _NAME + r")(?:\s?\|[^{}\n]{0,30})?\s?\}?\}\}", True),
    "dollar": (r"\$\{\s?(?P<n%d>" + _NAME + r")\s?\}", True),
    "hash": (r"#\{\s?(?P<n%d>" + _NAME + r")\s?\}", True),
    "smarty": (r"\{\$\s?(?P<n%d>" + _NAME + r")\s?\}", True),
    "tag": (r"\{%%-?\s?(?P<n%d>" + _NAME + r")\s?-?%%\}", True),
    "erb": (r"<%%[=-]?\s?(?P<n%d>" + _NAME + r")\s?%%>", True),
    "php": (r"<\?=?\s?\$?(?P<n%d>" + _NAME + r")\s?;?\s?\?>", True),
    "bracket_percent": (r"\[%%=?\s?(?P<n%d>" + _NAME + r")\s?%%\]", True),
    "printf": (r"%%\((?P<n%d>" + _NAME + r")\)[sd]", True),
    "at": (r"@@\s?(?P<n%d>" + _NAME + r")\s?@@", True),
    "insert": (r"[\[<(]\s?(?:insert|enter|your|add|type|fill in)\s(?P<n%d>" + _NAME + r")(?:\shere)?\s?[\]>)]", True),
    "wiki": (r"\[\[\s?(?P<n%d>" + _NAME + r")\s?\]\]", False),
    "brace": (r"(?<![{$#%%\w])\{\s?(?P<n%d>" + _NAME + r")\s?\}(?!\})", False),
    "percent": (r"(?<![\w%%\[{<])%%(?P<n%d>[^\W\d_]\w*)%%(?![\w\]}>])", False),
    "double_hash": (r"##(?P<n%d>" + _NAME + r")##", False),
    "under": (r"(?<!\w)__(?P<n%d>[^\W\d_]+(?:[_ ][^\W\d_]+)*)__(?!\w)", False),
    "capital_x": (r"(?<![^\W_])XX_(?P<n%d>\w+?)_XX(?![^\W_])", True),
    "escaped": (r"&lt;\s?(?P<n%d>" + _NAME + r")\s?&gt;", False),
}
SLOT = re.compile("|".join(f"(?P<s{i}>{p % i})" for i, (p, _) in enumerate(SHAPES.values())))
HINT = re.compile(r"\{|<[%?]|\[[%\[]|@@|##|__|XX_|%\w|%\(|&lt;|[\[<(](?:insert|enter|your|add|type|fill) |[\[\]{}<>#%_$@~^][^\W\d_][^\n]{0,60}?[\[\]{}<>#%_$@~^](?![^\s.,;:!?)])")
NAMES = list(SHAPES)
# A name between mirrored marks, whatever they are, and nothing between the delimiters of template languages.
MIRRORED = re.compile(r"(?<![^\s(])(?P<left>[\[\]{}<>#%_$@~^]{1,3})(?P<name>" + _NAME + r")(?P<right>[\[\]{}<>#%_$@~^]{1,3})(?![^\s.,;:!?)])")
MIRROR = str.maketrans("[{<", "]}>")
BLANK = re.compile(r"\{\{\s*\}\}|\$\{\s*\}|<%=?\s*%>|\[%\s*%\]|@@\s*@@|#\{\s*\}|\{%-?\s*%\}")
OPEN_QUOTES, CLOSE_QUOTES = "\"'`‘“«„‚", "\"'`’”»“‘"

# Words of filler text.
LOREM = set(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo "
    "consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)
# Lines that surround the content of a page.
FURNITURE_LINE = re.compile(
    r"""^\W*(?:(?:©|\(c\)|copyright\b).* | (?:(?:go\s)?back\sto|return\sto)\s(?:the\s)?(?:top|home|homepage|start(?:\spage)?|previous\spage) | report\sthis\s(?:problem|page) | all\srights\sreserved | skip\sto\s(?:main\s)?content | share\sthis(?:\spage)? | print\sthis\spage | was\sthis\spage\suseful\??)\W*$""", re.I | re.X
)
NAV_SPLIT = re.compile(r"\s*(?:[|·•/>»,–—-]|\t|\s{2,}|\.{3})\s*")
WORD = re.compile(r"[^\W\d_]+")


def slots(text: str) -> list[tuple[str, str, str, bool]]:
    """``(shape, name, frame, quoted)`` of every delimited span: its normalized name, empty for a blank, and the words around it."""
    if not HINT.search(text):
        return []
    out, taken = [], []

    def add(shape: str, name: str, start: int, end: int) -> None:
        before, after = text[start - 1 : start], text[end : end + 1]
        left = text[max(0, start - 24) : start].rpartition("\n")[2].split()[-2:]
        right = text[end : end + 24].partition("\n")[0].split()[:1]
        taken.append((start, end))
        out.append((shape, re.sub(r"[\W_]+", " ", name).strip().lower(), " ".join([*left, "*", *right]).lower(), bool(before) and before in OPEN_QUOTES and bool(after) and after in CLOSE_QUOTES))

    for m in SLOT.finditer(text):
        i = next(i for i in range(len(NAMES)) if m[f"s{i}"] is not None)
        add(NAMES[i], m[f"n{i}"], m.start(), m.end())
    for m in BLANK.finditer(text):
        add("blank", "", m.start(), m.end())
    for m in MIRRORED.finditer(text):
        if m["left"].translate(MIRROR)[::-1] == m["right"] and not any(x < m.end() and m.start() < y for x, y in taken):
            add(f"mirrored {m['left']}", m["name"], m.start(), m.end())
    return out


def is_nav(line: str) -> bool:
    """A menu: at least two short capitalized labels between separators."""
    line = line.strip()
    first = NAV_SPLIT.search(line)
    if not first or first.start() > 16:  # no label is longer
        return False
    parts = [p for p in NAV_SPLIT.split(line) if p]
    return len(parts) >= 3 and all(len(p) <= 16 and p[:1].isupper() and WORD.fullmatch(p) for p in parts) or len(parts) == 2 and "|" in line and all(len(p) <= 12 and p[:1].isupper() and WORD.fullmatch(p) for p in parts)


def is_filler(line: str) -> bool:
    """A line of filler words, or of a few words over and over."""
    kinds = set(line.lower().split())
    if len(kinds) > 9 and len(kinds & LOREM) * 4 < len(kinds):  # far from either, punctuation taken into account
        return False
    words = [w.lower() for w in WORD.findall(line)]
    if len(words) >= 2 and sum(w in LOREM for w in words) >= 0.8 * len(words) and any(len(w) > 3 for w in words):
        return True
    return len(words) >= 4 and len(set(words)) <= max(1, min(3, len(words) // 4))


QUOTED = re.compile(r"\"[^\"]*\"(\s*:)?|'[^']*'(\s*:)?")  # with a colon it is a key, which belongs to the template
PATH, DIGITS = re.compile(r"(?:/[\w.-]++)++|\b\w++(?:\.\w++)++"), re.compile(r"\b[^\W\d]*+\d\w*+")
SENTENCE = re.compile(r"(?<=[.!?…])\s+")


def skeleton(line: str) -> str:
    """The line with its variable parts cut out: quoted strings, paths, numbers, identifiers."""
    s = " ".join(line.lower().split())
    if '"' in s or "'" in s:
        s = QUOTED.sub(lambda m: m[0] if m[1] or m[2] else "*", s)
    if "/" in s or "." in s[:-1]:
        s = PATH.sub("*", s)
    return DIGITS.sub("#", s)


def units(text: str, known: re.Pattern | None = None) -> list[tuple[str, int]]:
    """``(skeleton, marks)`` of each sentence of the lines that are no furniture; marks: FILLER (or known), SHORT."""
    out = []
    for line in text.splitlines():
        if not line.strip() or FURNITURE_LINE.search(line) or is_nav(line):
            continue
        whole = line.strip()
        filler = is_filler(whole)
        parts = [whole] if filler else SENTENCE.split(whole)
        for part in parts if len(parts) > 1 else [whole]:
            told = filler or part is not whole and is_filler(part) or known is not None and known.search(part) is not None
            out.append((skeleton(part), (FILLER if told else 0) | (SHORT if len(part.split()) <= SHORT_WORDS else 0)))
    if len(out) >= 4 and len({x.rstrip(".!?… ") for x, _ in out}) == 1:  # one line over and over
        out = [(x, m | FILLER) for x, m in out]
    return [(x, m) for x, m in out if m & FILLER or WORD.search(x)]  # what is all slots tells nothing


def with_slot(skeleton_: str) -> list[tuple[int, int]]:
    """``(hash of the skeleton with one word left out, hash of that word)`` for each word of a sentence, however long: what a slot can be.

    A skeleton's hash is the sum of its words' hashes, seeded with their places, so that a word is exchanged without a look at the others.
    """
    words = skeleton_.split()
    if len(words) < 2:
        return []
    parts = [_digest(w, i) for i, w in enumerate(words)]
    whole = sum(parts)
    return [(((whole - parts[i] + _digest(WORD.sub("_", w), i)) & MASK) - (1 << 63), _hash(w)) for i, w in enumerate(words) if WORD.search(w)]


def _paged(docs: DataFrame, id_col: str, text_col: str, site_col: str | None) -> DataFrame:
    """``(id, text, page)``: page is a hash of the text and its site, so a text fetched again is the same page."""
    page = F.xxhash64(F.col(text_col), F.col(site_col) if site_col else F.lit(None).cast("string"))
    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"), page.alias("page")).where("text is not null")


def _rows(batch_rows: list[tuple], kinds: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    cols = list(zip(*batch_rows, strict=True)) if batch_rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, kinds, strict=True)], names=[n for n, _ in kinds])


def evidence(paged: DataFrame, known: str | None = None) -> DataFrame:
    """``(id, page, u, marks, n, shape, name, frame)``: a row for each sentence of each text (u: hash of its skeleton, n: sentences of the page) and for each
    slot that is not quoted (u null)."""
    kinds = [("id", pa.int64()), ("page", pa.int64()), ("u", pa.int64()), ("marks", pa.int32()), ("n", pa.int32()), ("shape", pa.string()), ("name", pa.string()), ("frame", pa.string())]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(known) if known else None
        for batch in it:
            rows: list[tuple] = []
            row, u, marks, n = [], [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                rows += [(k, shape, name, frame) for shape, name, frame, quoted in slots(text) if not quoted]
                found = dict(units(text, pattern))
                row += [k] * len(found)
                n += [len(found)] * len(found)
                u += map(_hash, found)
                marks += found.values()
            at, shape, name, frame = zip(*rows, strict=True) if rows else [()] * 4
            of = pa.array([*row, *at], pa.int64())
            none, zero = [None] * len(row), [0] * len(rows)
            cols = [batch.column(0).take(of), batch.column(2).take(of), [*u, *[None] * len(rows)], [*marks, *zero], [*n, *zero], [*none, *shape], [*none, *name], [*none, *frame]]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, (_, t) in zip(cols, kinds, strict=True)], names=[x for x, _ in kinds])

    return paged.mapInArrow(run, "id bigint, page bigint, u bigint, marks int, n int, shape string, name string, frame string")


MASK = (1 << 64) - 1


def _digest(x: str, seed: int = 0) -> int:
    return xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"), seed)


def _hash(x: str) -> int:
    return _digest(x) - (1 << 63)


def slot_evidence(paged: DataFrame) -> DataFrame:
    """``(page, u, v, w)``: the sentences of each text with one word left out: hash of the sentence, of what is left, of the word."""
    kinds = [("page", pa.int64()), ("u", pa.int64()), ("v", pa.int64()), ("w", pa.int64())]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows: list[tuple] = []
            for text, page in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                for x in dict(units(text.as_py())):
                    u = _hash(x)
                    rows += [(page, u, v, w) for v, w in with_slot(x)]
                    if len(rows) >= SLOT_ROWS:
                        yield _rows(rows, kinds)
                        rows = []
            yield _rows(rows, kinds)

    return paged.mapInArrow(run, "page bigint, u bigint, v bigint, w bigint")


def placeholders(slot: DataFrame) -> DataFrame:
    """The ``id`` of each text with a slot that is residue, from the slots of ``evidence``."""
    sure = F.col("shape").isin([n for n, (_, s) in SHAPES.items() if s] + ["blank"])
    names = slot.where("name <> ''").groupBy("name").agg(
        F.count_distinct(F.when(F.col("shape").isin(NAMES), F.col("shape"))).alias("forms"), F.count_distinct("page").alias("pages"), F.count(F.when(sure, 1)).alias("surely")
    )
    variable = names.where("surely >= 1 or (pages >= 3 and forms >= 2)").select("name", F.lit(True).alias("variable"))
    held = slot.join(variable, "name", "left").withColumn("variable", F.coalesce("variable", F.lit(False)))
    # other delimiters are a template's if most of their spans hold variable names
    shapes = held.groupBy("shape").agg(F.avg(F.col("variable").cast("int")).alias("share"), F.count_distinct("page").alias("in_pages"))
    usual = shapes.where("share >= 0.5").select("shape", F.lit(True).alias("usual"))
    return held.join(usual, "shape", "left").where(sure | (F.col("variable") & F.coalesce("usual", F.lit(False)))).select("id", "page")


def template_residue(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_pages: int = 3, site_col: str | None = None, known: str | None = None) -> DataFrame:
    """``(id, reason)``, a row for each id with a text that is residue: "placeholder", else "page".

    A name counts as a variable if it stands between delimiters of template languages anywhere, or fills slots of at least two delimiter forms in
    three pages. A sentence counts as a template's if it stands in at least ``min_pages`` pages, however many other texts there are, half of which hold
    such sentences, filler and furniture only; with one word left out it takes 2 * ``min_pages`` pages and ``min_pages`` different words. A text fetched again
    from the same site (with no ``site_col``, from anywhere) is the same page. A page of more than TEMPLATE_SENTENCES different sentences besides filler is
    none. ``known`` is a regular expression of sentences that are residue wherever they fill a page, for collections too small to show it; none by default.
    Null and blank texts are no residue; each row is judged by its own text, and an id is residue if one of its rows is, a null id too; other columns
    are ignored; an empty table gives no rows.
    """
    paged = _paged(docs, id_col, text_col, site_col)
    facts = cut(evidence(paged, known))
    residue = placeholders(facts.where("u is null")).select("id", F.lit("placeholder").alias("reason"))

    told = (F.col("marks").bitwiseAND(FILLER) != 0).alias("told")
    pages = facts.where("u is not null").groupBy("page", "u").agg(F.max(told).alias("told"), F.max(F.col("marks").bitwiseAND(SHORT) != 0).alias("short"), F.max("n").alias("n"))
    support = pages.groupBy("u").agg(F.count("*").alias("pages"))
    repeated = support.where(F.col("pages") >= min_pages)
    seen = cut(pages.join(repeated, "u", "left").where("pages is not null or told"))  # what is not repeated counts in n alone

    # pages of which a third is repeated: their other sentences are aligned with one word left out
    partly = seen.groupBy("page").agg(F.count("*").alias("covered"), F.max("n").alias("n")).where("covered < n and covered * 3 >= n").select("page")
    variants = slot_evidence(semi_join(paged, partly, "page").select("id", "text", "page")).dropDuplicates(["page", "u", "v"])
    variants = cut(variants.join(seen.select("page", "u"), ["page", "u"], "left_anti"))
    slotted = variants.groupBy("v").agg(F.count_distinct("page").alias("pages"), F.count_distinct("w").alias("words")).where((F.col("pages") >= 2 * min_pages) & (F.col("words") >= min_pages))
    sizes = seen.groupBy("page").agg(F.max("n").alias("n"))
    induced = variants.join(slotted.select("v", "pages"), "v").join(sizes, "page").select("page", "u", F.lit(False).alias("told"), F.lit(False).alias("short"), "n", F.col("v").alias("t"), "pages")
    every = cut(seen.select("page", "u", "told", "short", "n", F.col("u").alias("t"), "pages").unionByName(induced))

    hollow = every.groupBy("page").agg(F.count_distinct("u").alias("covered"), F.max("n").alias("n")).where("covered = n").select("page", F.lit(1).alias("hollow"))
    alone = every.where("pages is not null").join(hollow, "page", "left").groupBy("t").agg(F.count("hollow").alias("alone"), F.max("pages").alias("pages"))
    template = alone.where("alone * 2 >= pages").select("t", F.lit(True).alias("template"))
    judged = every.join(template, "t", "left").withColumn("template", F.coalesce("template", F.lit(False)) | F.col("told"))
    held = judged.groupBy("page", "u").agg(F.max("template").alias("template"), F.max("short").alias("short"), F.max("told").alias("told"), F.max("n").alias("n")).where("template or short")
    residual = held.groupBy("page").agg(F.max("n").alias("n"), F.count("*").alias("covered"), F.count(F.when(F.col("template"), 1)).alias("templates"), F.count(F.when(F.col("told"), 1)).alias("told"))
    residual = residual.where(f"covered = n and templates > 0 and n - told <= {TEMPLATE_SENTENCES}").select("page")

    hollow_ids = facts.where("u is not null").select("id", "page").distinct().join(residual, "page").select("id", F.lit("page").alias("reason"))
    return residue.unionByName(hollow_ids).groupBy("id").agg(F.max("reason").alias("reason"))


def without_residue(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str | None = None) -> DataFrame:
    """The rows of ``docs`` whose id is no residue, all columns kept."""
    bad = template_residue(docs, id_col, text_col, site_col=site_col).select(F.col("id").alias("_residue"))
    return docs.join(bad, docs[id_col] == bad["_residue"], "left_anti")
