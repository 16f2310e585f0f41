"""Words as every operator here understands them: maximal runs of letters and digits, lower-cased."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters and digits of any script; Python's ``\w`` without the underscore.
WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """The words of a text in order; none for null."""
    if not text:
        return []
    low = text.lower()
    return WORD.findall(low) if len(low) == len(text) else [w.lower() for w in WORD.findall(text)]


def letters_digits(text: Column) -> Column:
    """The letters and digits of a text without anything else, lower-cased."""
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]+", ""))


def shards(texts: list[str | None], most: int = 4_000_000) -> Iterator[tuple[int, list[str | None]]]:
    """The texts of a batch in runs of about ``most`` characters, with the place of the first; a longer text is a run by itself."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t or "") > most:
            yield first, texts[first:i]
            first, held = i, 0
        held += len(t or "")
    if first < len(texts):
        yield first, texts[first:]
