"""Markdown headings by byte offset: a line scanner, and Arrow wrappers beside it."""

from __future__ import annotations

import bisect
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

from fathomtext.functions.text import WHITE


class Heading(NamedTuple):
    start: int
    level: int
    title: str
    path: tuple[str, ...]


def _trim(line: bytes) -> str:
    return line.decode("utf-8", "replace").strip(WHITE)


def _atx(line: bytes) -> tuple[int, str] | None:
    """Up to 3 spaces, 1 to 6 hashes, then a blank or the end; closing hashes go, an empty title is prose."""
    body = line.lstrip(b" ")
    if len(line) - len(body) > 3:
        return None
    rest = body.lstrip(b"#")
    level = len(body) - len(rest)
    if not 1 <= level <= 6 or (rest and rest[:1] not in (b" ", b"\t")):
        return None
    title = _trim(rest).rstrip("#").strip(WHITE)
    return (level, title) if title else None


def _underline(line: bytes) -> int:
    """1 for a line of = only, 2 for one of -, else 0; blanks at either side don't matter."""
    body = line.lstrip(b" ").rstrip(b" \t")
    return 0 if not body else 1 if not body.strip(b"=") else 2 if not body.strip(b"-") else 0


def _fence(line: bytes) -> tuple[bytes, int] | None:
    body = line.lstrip(b" ")
    for mark in (b"`", b"~"):
        n = len(body) - len(body.lstrip(mark))
        if n >= 3:
            return mark, n
    return None


def scan(text: bytes) -> list[Heading]:
    """Headings in order, each with the titles above it and its own. A fence that stays open hides the rest."""
    out: list[Heading] = []
    stack: list[tuple[int, str]] = []
    fence: tuple[bytes, int] | None = None
    above: tuple[int, bytes] | None = None  # a paragraph line that an underline would make a heading

    def push(start: int, level: int, title: str) -> None:
        while stack and stack[-1][0] >= level:
            stack.pop()
        stack.append((level, title))
        out.append(Heading(start, level, stack[-1][1], tuple(t for _, t in stack)))

    at = 0
    for line in text.split(b"\n"):
        here, at = at, at + len(line) + 1
        mark = _fence(line)
        if fence:
            if mark and mark[0] == fence[0] and mark[1] >= fence[1]:
                fence = None
            above = None
        elif mark:
            fence, above = mark, None
        elif found := _atx(line):
            push(here, *found)
            above = None
        elif above and (level := _underline(line)):
            push(above[0], level, _trim(above[1]))
            above = None
        else:
            above = (here, line) if _trim(line) else None
    return out


def path_at(headings: list[Heading], place: int, starts: list[int] | None = None) -> list[str] | None:
    """Path of the last heading at or before the place; starts: those of the headings, if at hand."""
    i = bisect.bisect_right(starts if starts is not None else [h.start for h in headings], place)
    return list(headings[i - 1].path) if i else None


def headings(text: Column) -> Column:
    """array<struct<start, level, title, path>> of a text Column."""

    @pandas_udf("array<struct<start:int,level:int,title:string,path:array<string>>>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else [{"start": h.start, "level": h.level, "title": h.title, "path": list(h.path)} for h in scan(t.encode())])

    return run(text)
