"""Query expansion: longest names of a glossary and a phrase dictionary, without overlaps, at most twelve additions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST = 12
CJK = re.compile("[㐀-鿿]")
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


def normalize_text(text: str) -> str:
    """As functions.text.normalize, for one text on the driver or in a task."""
    x = CAMEL.sub(" ", unicodedata.normalize("NFKC", text))
    return " ".join(re.sub("::|[_/]", " ", x).lower().split())


class Expander:
    """glossary: entries with canonical, aliases and identifiers; phrases: (phrase, concepts), used for CJK queries only."""

    def __init__(self, glossary: Iterable[dict], phrases: Iterable[tuple[str, Iterable[str]]] = ()):
        names = [(normalize_text(a), [e["canonical"], *(e.get("identifiers") or [])]) for e in glossary for a in e.get("aliases") or []]
        by_length = lambda pairs: sorted((p for p in pairs if p[0]), key=lambda p: -len(p[0]))
        self.names, self.phrases = by_length(names), by_length((p, list(c)) for p, c in phrases)

    def __call__(self, text: str) -> str:
        query = normalize_text(text)
        taken = bytearray(len(query))  # characters that a longer name has used
        added: dict[str, None] = {}
        for name, gives in self.names + (self.phrases if CJK.search(query) else []):
            at = query.find(name)
            while at >= 0 and any(taken[at : at + len(name)]):
                at = query.find(name, at + len(name))
            if at >= 0:
                taken[at : at + len(name)] = b"\1" * len(name)
                added.update(dict.fromkeys(gives))
        return " ".join([query, *list(added)[:MOST]]).strip()

    def column(self, c: Column) -> Column:
        """For a column of queries; the dictionaries travel with the function."""
        return F.pandas_udf(lambda s: s.map(lambda x: None if x is None else self(x)), "string")(c)

