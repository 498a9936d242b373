"""Place names in texts: folding of any script, and a gazetteer as one automaton."""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def folded(text: str | None) -> str:
    """Compatibility forms taken apart, marks dropped, lower case, single spaces; letters and digits of every script stay."""
    if not text:
        return ""
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return " ".join(re.sub(r"[^\w\s]", " ", text.lower()).split())


@F.pandas_udf(StringType())
def norm_place(texts: pd.Series) -> pd.Series:
    """folded() of a column; null reads as empty."""
    return texts.map(folded, na_action=None)


class Names:
    """Aliases with their payloads, searched both ways: aliases within a text, and a short text within an alias.

    Of several the longest alias counts, then the first.  Aliases within a text come from an Aho-Corasick automaton in
    one pass; aliases around a text from one string of all aliases, longest first, in which the first hit is the best.
    """

    def __init__(self, rows: Sequence[tuple[int, str, str]]) -> None:
        import ahocorasick

        first: dict[str, tuple[int, str]] = {}
        for pos, alias, place in sorted(rows, key=lambda r: r[0]):
            if key := folded(alias):
                first.setdefault(key, (pos, place))
        self.order = sorted(first, key=lambda k: (-len(k), first[k][0]))
        self.held, self.rank = first, {k: i for i, k in enumerate(self.order)}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for key, i in self.rank.items():
            self.automaton.add_word(key, i)
        self.automaton.make_automaton()
        self.line, self.starts = "\n".join(self.order), [0]
        for key in self.order:
            self.starts.append(self.starts[-1] + len(key) + 1)
        self.longest = len(self.order[0]) if self.order else 0

    def within(self, key: str) -> int | None:
        """The best alias that stands in a folded text, by rank."""
        return min((i for _, i in self.automaton.iter(key)), default=None) if key and self.order else None

    def around(self, key: str) -> int | None:
        """The best alias that a folded text stands in."""
        at = self.line.find(key) if key and len(key) <= self.longest else -1
        return None if at < 0 else bisect.bisect_right(self.starts, at) - 1

    def lookup(self, place: str) -> tuple[int, bool] | None:
        """The alias that a place's name is, else the best either way, and whether it is the name itself."""
        key = folded(place)
        if key in self.rank:
            return self.rank[key], True
        found = [i for i in (self.within(key), self.around(key)) if i is not None]
        return (min(found), False) if found else None

    def find(self, text: str | None, phrases: Sequence[str]) -> tuple[int, bool, int] | None:
        """rank of the alias, whether it is a phrase itself, and the phrase's place, -1 for the text: the best alias within
        the text, else what the first phrase that has one leads to."""
        best = self.within(folded(text))
        if best is not None:
            return best, False, -1
        return next(((*hit, k) for k, p in enumerate(phrases) if (hit := self.lookup(p))), None)
