"""Fuzzy search for short license notices.

A notice that may have k errors is cut into k + 1 pieces; in any text within k errors of it, one piece
stands unchanged. One automaton finds all pieces of all notices, and the regex library's bounded-error
matching verifies the surroundings of each and gives the span and the number of errors. Of matches of a notice that
overlap, the one with the fewest errors counts, then the first.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_left
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import regex
from pyspark.sql import DataFrame

from limnograph.llm.common import map_rows, plain_words


@dataclass(frozen=True)
class Notice:
    """A phrase of plain words, its label, and the errors (inserted, deleted or changed characters) it may have."""

    label: str
    phrase: str
    errors: int = 0


#: Fixed phrases that are matched word by word.
PHRASES = (
    Notice("mit", "mit license"),
    Notice("apache", "apache license"),
    Notice("gpl", "general public license"),
)
#: Short notices as they stand under texts, with an error for about every fourteen characters.
NOTICES = (
    Notice("mit", "released under the mit license", 2),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy", 5),
    Notice("apache", "licensed under the apache license version 2 0", 3),
    Notice("gpl", "this work is licensed under the gnu general public license version 3", 5),
    Notice("lgpl", "gnu lesser general public license", 2),
    Notice("cc-by-nc", "licensed under cc by nc 4 0", 2),
    Notice("cc-by-sa", "licensed under cc by sa 4 0", 2),
    Notice("bsd", "redistribution and use in source and binary forms", 3),
    Notice("mpl", "subject to the terms of the mozilla public license", 3),
    Notice("cc0", "dedicated to the public domain", 2),
    Notice("proprietary", "all rights reserved", 1),
)


def pieces(phrase: str, errors: int) -> list[tuple[int, str]]:
    """``phrase`` cut into ``errors`` + 1 pieces of about equal length, with their offsets."""
    n = errors + 1
    cuts = [len(phrase) * i // n for i in range(n + 1)]
    return [(a, phrase[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Searcher:
    def __init__(self, notices: Sequence[Notice]):
        if any(n.errors + 1 > len(n.phrase) for n in notices):
            raise ValueError("a notice needs more characters than errors")
        self.notices = notices
        seeds: dict[str, list[tuple[int, int]]] = {}
        for i, notice in enumerate(notices):
            for at, piece in pieces(notice.phrase, notice.errors):
                seeds.setdefault(piece, []).append((i, at))
        self._automaton = ahocorasick.Automaton()
        for piece, uses in seeds.items():
            self._automaton.add_word(piece, (len(piece), uses))
        self._automaton.make_automaton()
        # One error more than allowed is never needed; BESTMATCH gives the fewest errors.
        self._patterns = [regex.compile(rf"(?b)(?:{regex.escape(n.phrase, special_only=True)}){{e<={n.errors}}}")
                          for n in notices]

    def search(self, plain: str) -> list[tuple[int, int, int, int]]:
        """(start, stop, errors, notice) of all matches in plain words, sorted; phrases without errors at word bounds."""
        found, near = set(), {}
        size = len(plain)
        for end, (length, uses) in self._automaton.iter(plain):
            start = end - length + 1
            for i, at in uses:
                notice = self.notices[i]
                if not notice.errors:
                    stop = end + 1
                    if (start == 0 or plain[start - 1] == " ") and (stop == size or plain[stop] == " "):
                        found.add((start, stop, 0, i))
                    continue
                low = max(0, start - at - notice.errors)
                high = min(size, start - at + len(notice.phrase) + notice.errors)
                near.setdefault(i, set()).add((low, high))
        for i, windows in near.items():
            found.update((start, stop, errors, i) for start, stop, errors in self._apart(i, plain, windows))
        return sorted(found)

    def _apart(self, i: int, plain: str, windows: set[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """(start, stop, errors) of matches of notice ``i`` that do not overlap, the best first.

        Every match lies within a window. The best match of all windows is taken, and what windows have left before
        and behind it is searched again.
        """
        least = max(1, len(self.notices[i].phrase) - self.notices[i].errors)
        todo: list[tuple[int, int, int, int, int]] = []
        seen: set[tuple[int, int]] = set()
        taken: list[tuple[int, int, int]] = []  # sorted and apart

        def look(low: int, high: int) -> None:
            if high - low >= least and (low, high) not in seen:
                seen.add((low, high))
                if m := self._patterns[i].search(plain, low, high):
                    heapq.heappush(todo, (sum(m.fuzzy_counts), *m.span(), low, high))

        for window in windows:
            look(*window)
        while todo:
            errors, start, stop, low, high = heapq.heappop(todo)
            # The first match taken that ends behind the start of the window.
            at = bisect_left(taken, low, key=lambda t: t[1] - 1)
            if at < len(taken) and taken[at][0] < high:
                look(low, taken[at][0])
                look(taken[at][1], high)
                continue
            taken.insert(at, (start, stop, errors))
            look(low, start)
            look(stop, high)
        return taken


@lru_cache(maxsize=4)
def searcher(notices: tuple[Notice, ...]) -> Searcher:
    return Searcher(notices)


def _starts(text: str) -> list[tuple[int, int]]:
    """Spans of the words of ``text`` itself, in the order of the plain words."""
    return [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]


def _word_at(spaces: list[int], word: int) -> int:
    return spaces[word - 1] + 1 if word else 0


def find_notices(docs: DataFrame, notices: Sequence[Notice] = (*PHRASES, *NOTICES), text: str = "text",
                 keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``n_words`` and ``notices``: every match of every notice in the whole text.

    A match has the ``label`` and ``phrase`` of its notice, ``errors``, ``exact`` (a phrase that allows no
    errors), ``first_word`` (from 0), and ``start`` and ``stop``, code points in the text as it is. Case of
    A-Z and all that stands between words do not matter. Matches are sorted by place. A NULL or empty text
    has no words and no matches; rows are never left out; a notice that occurs twice is found twice. Columns
    named like a new one give way.
    """
    chosen = tuple(notices)

    def make():
        find = searcher(chosen)

        def run(texts):
            counts, matches = [], []
            for text_ in texts:
                plain = plain_words(text_).decode()
                counts.append(plain.count(" ") + 1 if plain else 0)
                found = find.search(plain)
                words = _starts(text_) if found else []
                spaces = [m.start() for m in re.finditer(" ", plain)] if found else []
                row = []
                for start, stop, errors, i in found:
                    inner = plain[start:stop]
                    lead = len(inner) - len(inner.lstrip(" "))
                    until = start + len(inner.rstrip(" "))
                    first, last = bisect_left(spaces, start + lead), bisect_left(spaces, until)
                    into, tail = start + lead - _word_at(spaces, first), until - _word_at(spaces, last)
                    row.append({"label": chosen[i].label, "phrase": chosen[i].phrase, "errors": errors,
                                "exact": not chosen[i].errors, "first_word": first,
                                "start": words[first][0] + into, "stop": words[last][0] + tail})
                matches.append(row)
            return [counts, matches]

        return run

    return map_rows(docs, [text], "n_words long, notices array<struct<label: string, phrase: string, errors: int, "
                    "exact: boolean, first_word: long, start: long, stop: long>>", make, keep)
