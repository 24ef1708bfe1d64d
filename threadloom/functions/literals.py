"""Many literals found in one reading of a text.

All literals share one pattern, a tree of their common beginnings, which gives the longest literal that starts at each
place of a text. The shorter ones that start there are beginnings of it and need no search of their own. A literal
that can overlap itself is counted by replacement, and only in the texts that hold it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_FAN = 6  # branches tried one by one; more are first told apart by groups of characters


def folded(c: str) -> str:
    """A character as Java compares it without case: its upper, then its lower character, each a single one."""
    up = c.upper()
    if len(up) > 1:
        up = c.title() if len(c.title()) == 1 else c
    return up.lower()[0] if len(up.lower()) > 1 else up.lower()


@cache
def _cased() -> dict[str, str]:
    every = (chr(k) for k in range(0x110000) if not 0xD800 <= k < 0xE000)
    return {c: f for c in every if (f := folded(c)) != c}


def fold_literal(term: str) -> str:
    return "".join(map(folded, term))


def fold_text(text: Column, terms: Sequence[str]) -> Column:
    """The text with every character that equals one of the terms but for its case replaced by the folded one."""
    used = set("".join(map(fold_literal, terms)))
    pairs = [(c, f) for c, f in _cased().items() if f in used]
    return F.translate(text, "".join(c for c, _ in pairs), "".join(f for _, f in pairs)) if pairs else text


def overlaps_itself(term: str) -> bool:
    """Whether some beginning of the term is also its end."""
    return any(term.endswith(term[:n]) for n in range(1, len(term)))


def levels(terms: Sequence[str]) -> list[list[str]]:
    """The terms in lists of which none holds a term that begins with another of the list."""
    known, out = set(terms), []
    for term in sorted(known):
        depth = sum(term[:n] in known for n in range(1, len(term)))
        while len(out) <= depth:
            out.append([])
        out[depth].append(term)
    return out


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or ord(c) > 127 else f"\\x{ord(c):02x}" for c in text)


def tree_pattern(terms: Sequence[str]) -> str:
    """A pattern that matches the longest of the terms at a place, with common beginnings tried once."""
    root: dict = {}
    for term in terms:
        node = root
        for c in term:
            node = node.setdefault(c, {})
        node[""] = {}

    def branch(c: str, node: dict) -> str:
        run = c
        while len(node) == 1 and "" not in node:
            ((c, node),) = node.items()
            run += c
        return _quoted(run) + below(node)

    def below(node: dict) -> str:
        ways = sorted(c for c in node if c)
        if not ways:
            return ""
        if len(ways) > _FAN:
            groups = [ways[at : at + _FAN] for at in range(0, len(ways), _FAN)]
            parts = [f"(?=[{''.join(map(_quoted, g))}])(?:{'|'.join(branch(c, node[c]) for c in g)})" for g in groups]
        else:
            parts = [branch(c, node[c]) for c in ways]
        return f"(?:{'|'.join(parts)})" + ("?" if "" in node else "")

    return below(root)


def longest_at_each_place(text: Column, terms: Sequence[str]) -> Column:
    """For every place of the text where terms start, the longest of them."""
    return F.regexp_extract_all(text, F.lit(f"(?=({tree_pattern(terms)}))"), F.lit(1))


def literal_hits(text: Column, terms: Sequence[str]) -> Column:
    """Array of (term, n, longest): counts of terms in the text, as ``literals_of`` shares them out.

    ``longest`` is true for the longest term at one place, which counts for all its beginnings, too.
    """
    plain = [t for t in terms if not overlaps_itself(t)]
    own = sorted({t for t in terms if overlaps_itself(t)})
    parts = []
    if plain:
        hits = longest_at_each_place(text, plain)
        parts.append(F.transform(hits, lambda t: F.struct(t.alias("hit"), F.lit(1).cast("bigint").alias("n"), F.lit(True).alias("longest"))))
    if own:
        held = [longest_at_each_place(text, some) for some in levels(own)]
        found = F.array_distinct(reduce(F.concat, held))

        def counted(t: Column) -> Column:
            gone = F.octet_length(text) - F.octet_length(F.replace(text, t, F.lit("")))
            return F.struct(t.alias("hit"), (gone / F.octet_length(t)).cast("bigint").alias("n"), F.lit(False).alias("longest"))

        parts.append(F.transform(found, counted))
    return reduce(F.concat, parts)


def literals_of(terms: Sequence[str]) -> list[tuple[str, bool, int]]:
    """(hit, longest, position of the term that it counts for), for every hit that ``literal_hits`` can give."""
    places: dict[str, list[int]] = {}
    for i, term in enumerate(terms):
        places.setdefault(term, []).append(i)
    out = []
    for hit, at in places.items():
        if overlaps_itself(hit):
            out += [(hit, False, i) for i in at]
        else:
            begins = [hit[:n] for n in range(1, len(hit) + 1)]
            out += [(hit, True, i) for b in begins if b in places and not overlaps_itself(b) for i in places[b]]
    return out
