"""What kind of text a passage is: running prose, a list, a table or junk.

Statistics of each passage give votes of labelling functions, none of which is right always. The accuracies of the functions are learned
from how they agree, by expectation-maximization over the patterns of votes that starts from their majority, and the learned model turns each pattern into posterior
probabilities of the types. There are at most 3**10 patterns, whatever the collection, and only their counts leave the workers.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import encodings
from lodestone.operators.storage import cut, dealt
from lodestone.sources.collection import latest

TYPES = ("prose", "list", "table", "junk")
_PROSE, _REST = ("prose",), ("list", "table", "junk")
# What the votes 0, 1 and 2 of each labelling function speak for: types, or none where it abstains. How far they are right is learned.
FUNCTIONS = {
    "long_segment": (_REST, (), _PROSE),
    "function_words": (_REST, (), _PROSE),
    "clause_word": (_REST, (), _PROSE),
    "sentence_end": (_REST, (), _PROSE),
    "figures": (_PROSE, (), ("table",)),
    "short_lines": (_PROSE, (), ("list", "table")),
    "cells": ((), (), ("table",)),
    "same_start": ((), (), ("list",)),
    "repetition": ((), (), ("junk",)),
    "few_tokens": (_PROSE, (), ("junk",)),
}
ROUNDS, SETTLED = 1000, 1e-9  # of expectation-maximization at most; change of a posterior below which it ends
MAX_WORDS = 100_000  # rows of common words

# Verbs, pronouns and conjunctions that stand in clauses and seldom in labels or phrases.
CLAUSE = {
    "en": "is are was were be it that does has have can will you they this which its their not if but than fell takes",
    "de": "ist sind wird hat haben war es er sie dass nicht wenn man werden noch aber seit",
    "fr": "est sont qui que il elle on ne pas se fait peut être comme faut mais",
    "es": "es son ha que se no está como pero hay fue ser más cuando",
    "ru": "не был если что это как но также при они она он быть только были",
}
# Lines around a passage.
AROUND = re.compile(r"^\W*(?:was this page useful|read more|see more|see also|learn more|q and a|share this|back to top|print this page)\W*$", re.I)
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
SEGMENT = re.compile(r"(?<=[.!?])[\"”»')\]]*\s+|\n+|\s+[|·•»>/]\s+|\s*\.\.\.\s*|\t+|\s{3,}|\s*\|\s*|;(?=\S)")
CELL = re.compile(r"\t|\||\s{3,}|[,;]\S|  ")
# What SEGMENT finds in a line with no other space than single ones and nothing of ODD, from the character before it on.
ODD, STOP = re.compile(r"[|·•»>/;]"), re.compile(r"[.!?][\"”»')\]]* ")
MAYBE = re.compile(r"\.(?:\s?[a-zA-Z]\s?\.|\s[\d(])")  # every ABBREVIATION has it
ABBREVIATION = re.compile(r"\b(?:[a-zA-Z]\s?\.\s?){2,}(?=\s|$)|\b(?:cf|ca|bzw|vgl|approx|etc|no|vol|fig)\.(?=\s[\d(])")
END = re.compile(r"[^\W_]['\"”»)\]%°]*[.!?]+[\"”»')\]]*\s*$")


def segmented(line: str) -> list[str]:
    """``SEGMENT.split(line)``, faster for most lines."""
    if "..." in line or ODD.search(line) or " ".join(line.split()) != line:
        return SEGMENT.split(line)
    out, at = [], 0
    for m in STOP.finditer(line):
        out.append(line[at : m.start() + 1])
        at = m.end()
    return [*out, line[at:]]


def in_cells(line: str) -> bool:
    """Whether CELL is found twice or more; in a line with no other space than single ones each takes a sign that is counted first."""
    if line.count(",") + line.count(";") + line.count("|") - line.count(", ") - line.count("; ") < 2 and " ".join(line.split()) == line:
        return False
    return len(CELL.findall(line)) >= 2


class Measurer:
    """Statistics and votes of a text under lists of common words by language."""

    def __init__(self, common: dict[str, list[str]]) -> None:
        self.common = {k: {w for w in v if len(w) > 1 or not w.isascii()} for k, v in common.items()}
        self.clause = {k: set(v.split()) for k, v in CLAUSE.items()}
        self.langs: dict[str, tuple[str, ...]] = {}
        for k in sorted(self.common):
            for w in self.common[k]:
                self.langs[w] = (*self.langs.get(w, ()), k)

    def measure(self, text: str) -> tuple[tuple, list[int]]:
        """``(statistics, votes)``; the last vote needs the length of doc_table and is left out."""
        chars = len(text)
        text = text.lower()
        if MAYBE.search(text):
            text = ABBREVIATION.sub(lambda m: m[0].replace(".", ""), text)
        lines = [x for x in text.splitlines() if x.strip() and not (len(x) < 40 and AROUND.match(x))]
        parts = [(seg, ws) for line in lines for seg in segmented(line) if seg and (ws := WORD.findall(seg))]
        words = [w for _, ws in parts for w in ws]
        n = len(words)
        solid = sum(map(len, text.split())) or 1
        letters = sum(map(len, words))
        votes_for: dict[str, int] = dict.fromkeys(sorted(self.common), 0)
        for langs, times in Counter(map(self.langs.get, words)).items():
            for k in langs or ():
                votes_for[k] += times
        lang = max(votes_for, key=votes_for.get) if votes_for and n else ""
        common, clause = self.common.get(lang, set()), self.clause.get(lang, set())
        known = common | clause
        best_words = best_common = 0
        best_share, clause_hit, ended = 0.0, 0, 0
        starts: dict[str, int] = {}
        segments = len(parts)
        for seg, ws in parts:
            start = " ".join(ws[:2]) if ws[0] in common and len(ws) > 1 else ws[0]
            starts[start] = starts.get(start, 0) + 1
            hits = [w for w in ws if w in known]
            if hits and sum(map(len, ws)) >= 0.45 * (len(seg) - seg.count(" ")):
                share, kinds = len(hits) / len(ws), len(set(hits))
                best_words = max(best_words, len(ws))
                if len(ws) >= 5 and (kinds, share) > (best_common, best_share) and share >= 0.2:
                    best_common, best_share = kinds, share
                if clause_hit < 2 and len(ws) >= 4 and share >= 0.2 and not clause.isdisjoint(hits):
                    clause_hit = max(clause_hit, 2 if len(ws) >= 8 or END.search(seg[-12:]) else 1)
                if ended < 2 and share >= 0.15 and END.search(seg[-12:]):
                    ended = max(ended, 2 if len(ws) >= 5 else 1)
        ended_lines = sum(bool(END.search(x[-12:])) for x in lines)
        per_line = n / max(1, len(lines))
        symbols = 1 - letters / solid
        celled = sum(map(in_cells, lines)) / max(1, len(lines))
        top = max(starts.values(), default=0) / max(1, segments)
        distinct = len(set(words)) / max(1, n)
        votes = [
            2 if best_words >= 8 else 1 if best_words >= 5 else 0,
            2 if best_common >= 3 and (best_words >= 8 or ended == 2) else 1 if best_common >= 3 else 0,
            clause_hit,
            ended,
            2 if symbols > 0.4 else 1 if symbols > 0.2 else 0,
            (2 if per_line <= 6 else 1 if per_line <= 8 else 0) if len(lines) >= 3 else 0,
            2 if celled > 0.6 and len(lines) >= 2 else 1 if celled > 0.3 else 0,
            (2 if top >= 0.6 else 1 if top >= 0.35 else 0) if segments >= 3 else 0,
            (2 if distinct < 0.45 else 1 if distinct < 0.6 else 0) if 10 <= n <= 120 else 0,
        ]
        stats = (n, sum(map(len, words)) / max(1, n), symbols, len(lines), ended_lines / max(1, len(lines)), (votes_for[lang] if lang else 0) / max(1, n), best_words, distinct, chars, lang)
        return stats, votes


STATS = "n_words bigint, mean_word_length double, symbol_ratio double, n_lines bigint, ended_lines double, common_words double, longest_segment bigint, distinct_words double, n_chars bigint, lang string"
MEASURED = f"doc_id bigint, {STATS}, pattern bigint"


def text_statistics(table: DataFrame, common_words: DataFrame, id_col: str = "doc_id", text_col: str = "passage_text") -> DataFrame:
    """``(doc_id, statistics of STATS, pattern)`` for each text that is not blank; ``pattern`` holds the votes in base 3.

    A text that does not look like prose is first put right where it was decoded with a wrong encoding, and measured again. The units that
    dictionaries are made of are counted in the pass that measures; texts that may be garbled wait for the counts of the whole table.
    """
    given = encodings.few_words(common_words)
    sc = table.sparkSession.sparkContext
    shared = sc.broadcast(given)
    names = [x.split()[0] for x in MEASURED.split(", ")]
    kinds = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}
    types = [kinds[x.split()[1]] for x in MEASURED.split(", ")]
    more = [("text", pa.string()), ("unit", pa.string()), ("n", pa.int64())]

    def measurer(words: dict[str, list[str]]) -> Measurer:
        return Measurer({k: [w.lower() for w in v] for k, v in words.items()})

    def coded(votes: list[int]) -> int:
        return sum(v * 3**k for k, v in enumerate(votes))

    def batch(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) if rows else [[]] * len(fields)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])

    fields = list(zip(names, types, strict=True))
    at = names.index("lang")

    def first(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, counts = measurer(shared.value), encodings.Counts(shared.value)

        def counted(least: int) -> list[tuple]:
            none = [None] * len(names)
            return [(*none[:at], lang, *none[at + 1 :], None, unit, n) for lang, unit, n in counts.take(least)]

        for b in it:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not t or not t.strip():
                    continue
                stats, votes = m.measure(t)
                garbled = not counts.add(t)
                rows.append((i, *stats, coded(votes), t if garbled and (votes[1] < 2 or votes[2] < 2) else None, None, None))
            yield batch([*rows, *counted(encodings.HELD)], [*fields, *more])
        yield batch(counted(0), [*fields, *more])

    def again(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, d = measurer(shared.value), learned.value
        for b in it:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                stats, votes = m.measure(encodings.restore(t, d)[0])
                rows.append((i, *stats, coded(votes)))
            yield batch(rows, fields)

    picked = table.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    seen = cut(picked.mapInArrow(first, f"{MEASURED}, text string, unit string, n bigint"))
    learned = sc.broadcast(encodings.describer(seen.where("unit is not null").select("lang", "unit", "n"), sorted(given)))
    waiting = dealt(seen.where("text is not null").select("doc_id", "text"))
    return seen.where("pattern is not null and text is null").select(*names).unionByName(waiting.mapInArrow(again, MEASURED))


@dataclass
class Model:
    """What was learned: posteriors of TYPES by pattern, the types' shares, and the probability of each vote by type and function."""

    posterior: dict[int, np.ndarray]
    prior: np.ndarray
    accuracy: np.ndarray


def majority(votes: np.ndarray) -> np.ndarray:
    """The share of each type in what the functions say, patterns x types; where none says anything, all types alike."""
    said = np.full((len(votes), len(TYPES)), 1e-6)
    for j, says in enumerate(FUNCTIONS.values()):
        for v, types in enumerate(says):
            for t in types:
                said[votes[:, j] == v, TYPES.index(t)] += 1 / len(types)
    return said / said.sum(axis=1, keepdims=True)


def learn(patterns: dict[int, int], rounds: int = ROUNDS) -> Model:
    """The model of patterns of votes, given how many texts have each.

    Expectation-maximization of a model in which the functions vote independently given the type. It starts from the agreement of the
    functions, the majority of what they say; one text's weight of even votes keeps probabilities above zero.
    """
    k = len(FUNCTIONS)
    if not patterns:
        return Model({}, np.full(len(TYPES), 1 / len(TYPES)), np.full((len(TYPES), k, 3), 1 / 3))
    keys = sorted(patterns)
    n = np.array([patterns[x] for x in keys], dtype=float)
    votes = np.array([[p // 3**j % 3 for j in range(k)] for p in keys])
    one = np.eye(3)[votes]  # patterns x functions x votes
    post = majority(votes)
    for _ in range(rounds):
        mass = post * n[:, None]
        own = mass.sum(axis=0)
        accuracy = (np.einsum("pt,pfv->tfv", mass, one) + 1) / (own + 3)[:, None, None]
        prior = (own + 1) / (n.sum() + len(TYPES))
        log = np.log(prior)[None, :] + np.einsum("pfv,tfv->pt", one, np.log(accuracy))
        new = np.exp(log - log.max(axis=1, keepdims=True))
        new /= new.sum(axis=1, keepdims=True)
        change, post = np.abs(new - post).max(), new
        if change < SETTLED:
            break
    return Model(dict(zip(keys, post, strict=True)), prior, accuracy)


def voted(table: DataFrame, doc_table: DataFrame, common_words: DataFrame, id_col: str = "doc_id", text_col: str = "passage_text") -> tuple[DataFrame, Model]:
    """The statistics with ``length`` and whole patterns of votes, and the model learned from them."""
    stats = text_statistics(table, common_words, id_col, text_col)
    lengths = latest(doc_table, ["doc_id"], "length")
    few = F.when(F.coalesce("length", F.lit(0)) < 12, 2).when(F.col("length") < 25, 1).otherwise(0)
    # texts of other scripts have no kept tokens and abstain
    few = F.when(F.col("lang") == "ru", 1).otherwise(few)
    votes = cut(stats.join(lengths, "doc_id", "left").withColumn("pattern", F.col("pattern") + few * 3 ** (len(FUNCTIONS) - 1)))
    return votes, learn({r["pattern"]: r["count"] for r in votes.groupBy("pattern").count().collect()})  # at most 3**10 rows


def accuracies(table: DataFrame, doc_table: DataFrame, common_words: DataFrame, id_col: str = "doc_id", text_col: str = "passage_text") -> DataFrame:
    """``(type, share, function, against, neither, for)``: the learned share of each type and how each function votes on it."""
    model = voted(table, doc_table, common_words, id_col, text_col)[1]
    rows = [(t, float(model.prior[i]), f, *map(float, model.accuracy[i, j])) for i, t in enumerate(TYPES) for j, f in enumerate(FUNCTIONS)]
    return table.sparkSession.createDataFrame(rows, "type string, share double, function string, against double, neither double, for double")


def text_types(table: DataFrame, doc_table: DataFrame, common_words: DataFrame, id_col: str = "doc_id", text_col: str = "passage_text") -> DataFrame:
    """``(doc_id, statistics, length, type, p_prose, p_list, p_table, p_junk)`` for each text that is not blank.

    length is the kept tokens that doc_table holds for the document, null without a row. type is the most probable one. Repeated rows
    give repeated rows, a null doc_id has a null length; other columns are ignored; an empty table gives no rows.
    """
    votes, model = voted(table, doc_table, common_words, id_col, text_col)
    spark = table.sparkSession
    rows = [(int(p), *map(float, q)) for p, q in model.posterior.items()]
    types = spark.createDataFrame(rows, "pattern bigint, " + ", ".join(f"p_{t} double" for t in TYPES))
    best = F.greatest(*[F.col(f"p_{t}") for t in TYPES])
    kind = F.coalesce(*[F.when(F.col(f"p_{t}") == best, t) for t in TYPES])
    return votes.join(F.broadcast(types), "pattern").withColumn("type", kind).drop("pattern")
