"""Loading delimited lines with a quote-aware finite-state tokenizer; bad lines come out with a reason and an offset.

The tokenizer is an automaton over bytes. A line is cut into chunks of fixed width; for every chunk the automaton is run
from all of its states at once, which gives the chunk's map from states to states. The maps of a line's chunks are composed by
doubling, which yields the state at the start of every chunk, and a second run from that state gives the state at every byte.
All chunks of a batch advance together as array operations, so one very long line takes the same path as many short ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 64
START, PLAIN, QUOTED, CLOSED, BROKEN = range(5)  # at a field's start; in a plain, a quoted field; after a quote in it; text after that
OTHER, QUOTE, TAB, PAD = range(4)
NEXT = np.array(
    [
        # other, quote, tab, padding
        [PLAIN, QUOTED, START, START],
        [PLAIN, PLAIN, START, PLAIN],
        [QUOTED, CLOSED, QUOTED, QUOTED],
        [BROKEN, QUOTED, START, CLOSED],
        [BROKEN, BROKEN, BROKEN, BROKEN],
    ],
    dtype=np.uint8,
)
SLICE = 1 << 23  # bytes of lines that are tokenized at once

ID = re.compile("[0-9]{1,9}")
BAD = re.compile("[\x00-\x08\x0a-\x1f\x7f�]")
FULL = re.compile("[^ \t ]")

REASONS = ("null line", "text after closing quote", "unclosed quote", "wrong number of fields", "bad passage_id", "bad character", "blank passage_text")
SCHEMA = "ok boolean, passage_id string, passage_text string, reason string, at bigint"


def line_states(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The state before every byte of ``data`` that lies in a line, and the state at the end of each line."""
    kind = np.zeros(256, dtype=np.uint8)
    kind[ord('"')], kind[ord("\t")] = QUOTE, TAB
    lengths = ends - starts
    n_chunks = np.maximum(1, -(-lengths // CHUNK))
    first = np.concatenate(([0], np.cumsum(n_chunks)[:-1]))
    line = np.repeat(np.arange(len(starts)), n_chunks)
    part = np.arange(len(line)) - first[line]
    at = (starts[line] + part * CHUNK)[:, None] + np.arange(CHUNK)[None, :]
    inside = at < ends[line][:, None]
    codes = np.where(inside, kind[data[np.minimum(at, max(0, len(data) - 1))]] if len(data) else PAD, PAD).astype(np.uint8)
    maps = np.tile(np.arange(5, dtype=np.uint8), (len(line), 1))
    for j in range(CHUNK):
        maps = NEXT[maps, codes[:, j][:, None]]
    hop = 1
    while hop < (int(n_chunks.max()) if len(n_chunks) else 0):  # after this, maps[i] leads from the line's start to the end of chunk i
        far = np.flatnonzero(part >= hop)
        maps[far] = np.take_along_axis(maps[far], maps[far - hop], axis=1)
        hop *= 2
    reached = maps[:, START]
    state = np.where(part > 0, np.concatenate(([START], reached[:-1])), START).astype(np.uint8)
    before = np.empty((len(line), CHUNK), dtype=np.uint8)
    for j in range(CHUNK):
        before[:, j] = state
        state = NEXT[state, codes[:, j]]
    out = np.full(len(data), START, dtype=np.uint8)
    out[at[inside]] = before[inside]
    return out, reached[first + n_chunks - 1]


def unquote(field: str) -> str:
    return field[1:-1].replace('""', '"') if field[:1] == '"' else field


def check_line(line: str, cut: int) -> tuple:
    """The row of a line whose quoting is right and whose one separating tab is at character ``cut``."""
    left, right = line[:cut], line[cut + 1 :]
    pid, text = unquote(left), unquote(right)
    if not ID.fullmatch(pid):
        return False, None, None, "bad passage_id", 0
    if BAD.search(text):
        return False, None, None, "bad character", cut + 1 + BAD.search(right).start()
    if not FULL.search(text):
        return False, None, None, "blank passage_text", cut + 1
    return True, pid, text, None, None


def tokenize(lines: list[str | None]) -> list[tuple]:
    """A row of ``SCHEMA`` for each line."""
    raw = [(x or "").encode("utf-8", "surrogatepass") for x in lines]
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    ends = np.cumsum([len(x) for x in raw]).astype(np.int64)
    starts = ends - np.array([len(x) for x in raw], dtype=np.int64)
    before, last = line_states(data, starts, ends)
    splits = np.flatnonzero((data == ord("\t")) & np.isin(before, (START, PLAIN, CLOSED)))
    lo, hi = np.searchsorted(splits, starts), np.searchsorted(splits, ends)
    broken = np.flatnonzero(before == BROKEN)
    broken_at = np.searchsorted(broken, starts)
    out: list[tuple] = []
    for i, line in enumerate(lines):
        chars = lambda byte: len(raw[i][: byte - starts[i]].decode("utf-8", "surrogatepass"))  # noqa: B023, E731
        if line is None:
            out.append((False, None, None, "null line", 0))
        elif last[i] == BROKEN:
            k = broken_at[i]  # the byte before the first broken one broke the field
            byte = broken[k] - 1 if k < len(broken) and broken[k] < ends[i] else ends[i] - 1
            out.append((False, None, None, "text after closing quote", len(raw[i][: byte - starts[i]].decode("utf-8", "ignore"))))
        elif last[i] == QUOTED:
            opened = splits[hi[i] - 1] + 1 if hi[i] > lo[i] else starts[i]
            out.append((False, None, None, "unclosed quote", chars(opened)))
        elif hi[i] - lo[i] != 1:
            out.append((False, None, None, "wrong number of fields", chars(splits[lo[i] + 1]) if hi[i] - lo[i] > 1 else len(line)))
        else:
            out.append(check_line(line, chars(splits[lo[i]])))
    return out


def _slices(lines: list[str | None]) -> Iterator[list[str | None]]:
    at, size = 0, 0
    for i, x in enumerate(lines):
        size += len(x or "")
        if size >= SLICE:
            yield lines[at : i + 1]
            at, size = i + 1, 0
    if at < len(lines):
        yield lines[at:]


def parse_lines(table: DataFrame, column: str = "raw_line", keys: tuple[str, ...] = ("line_no",)) -> DataFrame:
    """``(*keys, ok, passage_id, passage_text, reason, at)``, one row for each row of ``table``.

    Fields are separated by tabs; a field that starts with a double quote runs to its closing quote, tabs within are text and
    two quotes stand for one. A line is valid with right quoting, two fields, a passage_id of 1 to 9 ASCII digits and a
    passage_text with something else than blanks and without control characters (tab excepted), U+007F and U+FFFD. Nothing is
    trimmed. Of invalid lines, reason is one of REASONS and ``at`` the character offset of the fault in the line. A null line
    is invalid; null keys, repeated rows and other columns change nothing; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*keys, "ok", "passage_id", "passage_text", "reason", "at"]
        types = (pa.bool_(), pa.string(), pa.string(), pa.string(), pa.int64())
        for b in batches:
            done: list[tuple] = []
            for lines in _slices(b.column(len(keys)).to_pylist()):
                done += tokenize(lines)
            cols = list(zip(*done, strict=True)) if done else [[]] * 5
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keys))), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=names)

    picked = table.select(*keys, F.col(column).cast("string").alias("_line"))
    kinds = dict(picked.dtypes)
    return picked.mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", " + SCHEMA)


def loaded(table: DataFrame) -> DataFrame:
    """Valid lines, typed: ``(line_no, passage_id bigint, passage_text)``."""
    return parse_lines(table).where("ok").select("line_no", F.col("passage_id").cast("bigint").alias("passage_id"), "passage_text")


def rejected(table: DataFrame) -> DataFrame:
    """Invalid lines: ``(line_no, reason, at)``."""
    return parse_lines(table).where("not ok").select("line_no", "reason", "at")
