"""Token and cleaning expressions; all of them run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The token rule of the collection format.
TOKEN_PATTERN = "[a-z0-9]+"
MIN_TOKEN, MAX_TOKEN = 2, 20

# Fixed value: every code point that counts as white space when a line is stripped.
STRIP_CLASS = r"[\x{1c}-\x{1f}\x{85}\s\p{Z}]"


def tokens(text: Column) -> Column:
    """Kept tokens of ``text`` in order, with repeats.

    A token is a maximal run of ``[a-z0-9]`` in the lower-cased text with 2 to 20 characters; longer and shorter runs
    are dropped whole. A null text gives an empty array.
    """
    runs = F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))
    kept = F.filter(runs, lambda t: F.length(t).between(MIN_TOKEN, MAX_TOKEN))
    return F.coalesce(kept, F.array().cast("array<string>"))


def has_token(text: Column) -> Column:
    """Whether ``text`` has a kept token; looks no further than the first one."""
    return F.coalesce(F.lower(text).rlike(f"(?<![a-z0-9])[a-z0-9]{{{MIN_TOKEN},{MAX_TOKEN}}}(?![a-z0-9])"), F.lit(False))


def query_terms(text: str) -> list[str]:
    """The distinct kept tokens of a query string, first occurrence first."""
    import re

    runs = re.findall(TOKEN_PATTERN, text.lower())
    return list(dict.fromkeys(t for t in runs if MIN_TOKEN <= len(t) <= MAX_TOKEN))


def strip(text: Column) -> Column:
    """``text`` without Unicode white space at both ends."""
    return F.regexp_replace(text, f"^{STRIP_CLASS}+|{STRIP_CLASS}+$", "")


def drop_invalid_utf8(line: Column) -> Column:
    """``line`` without the bytes that are not valid UTF-8; valid lines stay as they are.

    In a line with invalid bytes, genuine U+FFFD characters become blanks, which leaves the tokens unchanged.
    """
    mark = F.lit("�")
    repaired = F.translate(F.make_valid_utf8(F.replace(line, mark, F.lit(" "))), "�", "")
    return F.when(F.is_valid_utf8(line), line).otherwise(repaired)
