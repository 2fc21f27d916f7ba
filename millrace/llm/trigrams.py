"""Trigram queries that every match of a regular expression must satisfy, and a trigram index over texts."""

from __future__ import annotations

import re
from re import _constants as C
from re import _parser

Conjunction = frozenset
_MOST_EXACT, _MOST_TERMS = 64, 200


def _of(strings: set[str]) -> list[Conjunction]:
    """An OR over strings of the AND over their trigrams; no condition if some string is too short for one."""
    sets = [frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings]
    return [] if any(not x for x in sets) else list(dict.fromkeys(sets))


def _both(a: list[Conjunction], b: list[Conjunction]) -> list[Conjunction]:
    if not a or not b:
        return a or b
    if len(a) * len(b) > _MOST_TERMS:
        return min(a, b, key=lambda q: (len(q), -min(map(len, q))))
    return list(dict.fromkeys(x | y for x in a for y in b))


def _walk(items) -> tuple[set[str] | None, list[Conjunction]]:
    """(the strings that are the whole match, or None if there are too many to list; the condition)."""
    whole: set[str] | None = {""}
    current, must = {""}, []

    def flush():
        nonlocal current, must, whole
        must = _both(must, _of(current))
        current, whole = {""}, None

    def extend(strings: set[str]):
        nonlocal current, whole
        if len(current) * len(strings) > _MOST_EXACT:
            flush()
        current = {a + b for a in current for b in strings}

    for op, arg in items:
        if op is C.LITERAL:
            extend({chr(arg).lower()})
        elif op is C.IN and all(o is C.LITERAL for o, _ in arg) and len(arg) <= 4:
            extend({chr(a).lower() for _, a in arg})
        elif op is C.SUBPATTERN:
            exact, cond = _walk(arg[3])
            if exact is not None:
                extend(exact)
            else:
                flush()
                must = _both(must, cond)
        elif op is C.BRANCH:
            parts = [_walk(x) for x in arg[1]]
            if all(e is not None for e, _ in parts):
                extend(set().union(*[e for e, _ in parts]))
            else:
                flush()
                conds = [_of(e) if e is not None else c for e, c in parts]
                if all(conds):
                    must = _both(must, [x for c in conds for x in c])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            low, high, body = arg
            exact, cond = _walk(body)
            if exact is not None and (low, high) == (0, 1):
                extend(exact | {""})
            elif exact is not None and low == high and low <= 8:
                for _ in range(low):
                    extend(exact)
            else:
                if low >= 1 and exact is not None:
                    extend(exact)
                flush()
                if low >= 1 and exact is None:
                    must = _both(must, cond)
        elif op is C.AT or op in (C.ASSERT, C.ASSERT_NOT):
            continue
        else:
            flush()
    if whole is not None and current != {""}:
        return current, _of(current)
    must = _both(must, _of(current))
    return (None, must) if whole is None else ({""}, [])


def required_trigrams(pattern: str, flags: int = 0) -> list[Conjunction]:
    """An OR of ANDs of lower-case trigrams; [] means that any text may match."""
    return _walk(_parser.parse(pattern, flags))[1]


class TrigramIndex:
    """An inverted index over the texts of one shard: the rows in which each wanted trigram occurs, case ignored.

    Texts are spread over shards as Spark reads them, one Arrow batch each, so that lists are intersected where they are built
    and neither postings nor texts are shuffled.
    """

    def __init__(self, texts: list[str | None], wanted: set[str]):
        self.n = len(texts)
        self.postings: dict[str, set[int]] = {g: set() for g in wanted}
        for row, text in enumerate(texts):
            if text:
                low = text.lower()
                grams = (g for g in wanted if g in low) if len(low) > 8 * len(wanted) else wanted.intersection(low[i : i + 3] for i in range(len(low) - 2))
                for g in grams:
                    self.postings[g].add(row)

    def rows(self, query: list[Conjunction]) -> set[int]:
        """The rows that satisfy a query, shortest lists first; all rows for an empty query."""
        if not query:
            return set(range(self.n))
        out: set[int] = set()
        for conj in query:
            lists = sorted((self.postings[g] for g in conj), key=len)
            hit = set(lists[0])
            for more in lists[1:]:
                if not hit:
                    break
                hit &= more
            out |= hit
        return out
