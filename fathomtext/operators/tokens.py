"""Token budgets over a pluggable, prefix-monotonic counter; offsets are bytes."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

Counter = Callable[[str], int]
_WORD = re.compile(r"[^\t\n\x0b\f\r \x85\xa0  -     　]+")


def count_words(text: str) -> int:
    """The demonstration counter: words between white space."""
    return sum(1 for _ in _WORD.finditer(text))


def back_up(text: bytes, i: int) -> int:
    """The last place at or before i between code points."""
    if i >= len(text):
        return len(text)
    while i > 0 and text[i] & 0xC0 == 0x80:
        i -= 1
    return max(i, 0)


def truncate(count: Counter, text: bytes, most: int) -> bytes:
    """A prefix of at most ``most`` tokens by bisection over byte offsets.

    As in the behaviour to match, a step that lands inside the code point behind the lower
    bound ends the search, so the prefix isn't always the longest one on multibyte text.
    Counts grow with the prefix, so steps beyond one that is known to be too long, found by
    doubling, need no count: the work goes with the prefix, not with the text behind it."""
    if most <= 0:
        return text
    size = 16 * most
    while count(text[: (over := back_up(text, size))].decode("utf-8", "replace")) <= most:
        if over == len(text):
            return text
        size *= 2
    low, high = 0, len(text)
    while low < high:
        mid = back_up(text, (low + high + 1) // 2)
        if mid <= low:
            break
        if mid < over and count(text[:mid].decode("utf-8", "replace")) <= most:
            low = mid
        else:
            high = back_up(text, mid - 1)
    return text[:low]


def extent(count: Counter, text: bytes, start: int, limit: int, most: int) -> int:
    """End of the longest found prefix of text[start:limit]; one code point at least."""
    end = start + len(truncate(count, text[start:limit], most))
    if end > start:
        return end
    end = start + 1
    while end < limit and text[end] & 0xC0 == 0x80:
        end += 1
    return end


def truncate_tokens(text: Column, most: int, count: Counter = count_words) -> Column:
    @pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else truncate(count, t.encode(), most).decode("utf-8", "replace"))

    return run(text)


def count_tokens(text: Column, count: Counter = count_words) -> Column:
    @pandas_udf("int")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else count(t)).astype("Int32")

    return run(text)
