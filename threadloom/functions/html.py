"""Reading fields out of captured HTML with built-in expressions.

A page is cut once into tokens, and its tags are listed once with their names and places. All selectors are
expressions over that list: an element is found by its opening tag, its content is what stands before the closing
tag that balances it, and searches within a container see its content alone. An element that is never closed
reaches to the end of what is searched. Only elements that a selector asks for are balanced, each by one fold over
the later tags of its name, so work grows with the page's length times the elements asked for.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom.functions.text import stripped

# Comments, scripts and styles are no page content, though they may look like it.
HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
ANCHOR_HREF = r"(?is)<a\s(?:[^>]*?\s)?href\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)"
BREAKS = r"(?i)<br\s*/?>|</(?:p|div|li|h[1-6]|tr)\s*>"

# The standard's named characters, as a map that Spark folds into a constant.
NAMED = json.dumps({name: char for name, char in html5.items() if name.endswith(";")})
ENTITY = r"&(?:[a-zA-Z][a-zA-Z0-9]*|#[0-9]{1,9}|#[xX][0-9a-fA-F]{1,8});"
UNKNOWN = "\ufffd"
TAG_END = r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*>"
TAG_NAME = r"</?([a-zA-Z][\w-]*+)(?=[\s/>])"
TOKEN = rf"(?s){TAG_NAME}(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|{TAG_NAME}|[^<]++|<"
# Fixed value: an open paragraph ends where the next one begins.
UNNESTED = "p"

def visible(html: Column) -> Column:
    return F.regexp_replace(html, HIDDEN, "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _decoded(token: Column) -> Column:
    """One named or numeric entity as its character; unknown names stay as they are."""
    code = F.when(
        token.rlike("^&#[xX]"), F.conv(F.regexp_extract(token, "^&#[xX]([0-9a-fA-F]+);", 1), 16, 10)
    ).otherwise(F.regexp_extract(token, "^&#([0-9]+);", 1)).try_cast("bigint")
    fine = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    numeric = F.when(fine, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(F.lit(UNKNOWN))
    named = F.try_element_at(F.from_json(F.lit(NAMED), "map<string,string>"), F.substring(token, 2, 64))
    return F.when(token.startswith("&#"), numeric).otherwise(F.coalesce(named, token))


def unescape(text: Column) -> Column:
    """Entities replaced by their characters, each once."""

    def decoded(text: Column) -> Column:
        tokens = F.regexp_extract_all(text, F.lit(rf"{ENTITY}|[^&]+|&"), F.lit(0))
        whole = F.array_join(F.transform(tokens, lambda t: F.when(t.rlike(f"^{ENTITY}$"), _decoded(t)).otherwise(t)), "")
        return F.when(F.contains(text, F.lit("&")), whole).otherwise(text)

    return let(text, decoded)


def inner_text(fragment: Column) -> Column:
    """Text of a fragment: tags removed, entities decoded, white space collapsed."""
    plain = F.regexp_replace(F.regexp_replace(fragment, BREAKS, " "), rf"(?s)</?[a-zA-Z!?]{TAG_END}", "")
    return stripped(F.regexp_replace(unescape(plain), r"(?U)\s+", " "))


def unquoted(attribute: Column) -> Column:
    return F.regexp_replace(attribute, r"^([\"'])(?s)(.*)\1$", "$2")


@dataclass(frozen=True)
class Selector:
    """Elements inside elements, outermost first, by what their opening tag looks like after "<"; or an attribute."""

    path: tuple[str, ...]
    attribute: str | None = None


def element(opening: str) -> Selector:
    return Selector((opening,))


def inside(container: str, tag: str) -> Selector:
    """A ``tag`` anywhere inside a container."""
    return Selector((container, rf"{tag}\b"))


def attribute(opening: str, name: str) -> Selector:
    return Selector((opening,), name)


def having(name: str, value: str = "", mode: str = "=") -> str:
    """Opening-tag condition on an attribute: equal, containing ("*") or ending with ("$") a value."""
    if not value and mode == "=":
        return rf"[^>]*\s{name}(?:\s*=\s*(?:\"\"|''))?(?=[\s/>])(?!\s*=)"
    before, after = {"=": (False, False), "*": (True, True), "$": (True, False)}[mode]

    def form(left: str, other: str, right: str) -> str:
        return f"{left}{other if before else ''}{value}{other if after else ''}{right}"

    forms = form('\"', '[^\"]*', '\"'), form("'", "[^']*", "'"), form("", r"[^\s>\"']*", r"(?=[\s>])")
    return rf"[^>]*\s{name}\s*=\s*(?:{'|'.join(forms)})"


def with_class(name: str) -> str:
    return rf"[^>]*\sclass\s*=\s*(?:[\"'](?:[^\"']*\s)?{name}(?:\s[^\"']*)?[\"']|{name}(?=[\s>]))"


def page_tokens(html: Column) -> Column:
    """Tags, and what stands between them; joined they give the page again. A null page has none."""
    return F.coalesce(F.regexp_extract_all(html, F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def page_tags(tokens: Column) -> Column:
    """The tags of a page as structs: ``name``; ``ends`` for a closing tag; ``tag`` as written, empty if it is cut off,
    so that no selector reads it; ``at``, the number of its token."""

    def tag(token: Column, at: Column) -> Column:
        name = F.lower(F.regexp_extract(token, f"^{TAG_NAME}", 1))
        whole = F.when(token.endswith(">"), token).otherwise(F.lit(""))
        return F.when(token.startswith("<"), F.struct(name.alias("name"), token.startswith("</").alias("ends"), whole.alias("tag"), at.alias("at")))

    return F.filter(F.transform(tokens, tag), lambda t: t["name"] != "")


def elements(tags: Column, opening: str) -> Column:
    """The opening tags that fit, in document order."""
    return F.filter(tags, lambda t: t["tag"].rlike(rf"(?is)^<(?={opening})[a-z]"))


def balanced(tags: Column, opened: Column, end: Column) -> Column:
    """The opening tags with ``close``, the token that ends their element, or ``end`` if none does."""

    def close(e: Column) -> Column:
        own = F.filter(tags, lambda t: (t["at"] > e["at"]) & (t["name"] == e["name"]))
        start = F.struct(F.lit(1).alias("open"), F.lit(None).cast("int").alias("close"))

        def step(acc: Column, t: Column) -> Column:
            still = acc["open"] + F.when(t["ends"] | (t["name"] == UNNESTED), -1).otherwise(1)
            return F.when(acc["close"].isNotNull(), acc).otherwise(F.struct(still.alias("open"), F.when(still == 0, t["at"]).alias("close")))

        return F.least(F.aggregate(own, start, step, lambda acc: acc["close"]), end)

    return F.transform(opened, lambda e: e.withField("close", close(e)))


def part_of(tags: Column, e: Column) -> Column:
    """The tags in the content of a balanced element."""
    return F.filter(tags, lambda t: (t["at"] > e["at"]) & (t["at"] < e["close"]))


def _found(tags: Column, selector: Selector, end: Column) -> Column:
    """The first element a selector finds, as an array that is empty without one; ``value`` is its attribute."""
    outer, *inner = selector.path
    if selector.attribute:
        pattern = rf"(?is)\s{selector.attribute}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)"
        hits = F.slice(elements(tags, outer), 1, 1)
        return F.transform(hits, lambda e: F.struct(e["at"], e["at"].alias("close"), F.regexp_extract(e["tag"], pattern, 1).alias("value")))
    if inner:
        # Every container is searched on its own; the earliest find counts.
        within = lambda c: let(part_of(tags, c), lambda own: _found(own, Selector(tuple(inner)), c["close"]))
        return F.flatten(F.transform(balanced(tags, elements(tags, outer), end), within))
    first = balanced(tags, F.slice(elements(tags, outer), 1, 1), end)
    return F.transform(first, lambda e: F.struct(e["at"], e["close"], F.lit(None).cast("string").alias("value")))


def first_match(tokens: Column, tags: Column, selectors: Sequence[Selector], end: Column | None = None) -> Column:
    """What the selector that matches earliest finds; null without a match.

    ``tags`` may be those of a part of the page, which ends before token ``end``.
    """
    end = F.size(tokens) if end is None else end

    def content(e: Column) -> Column:
        return F.coalesce(e["value"], F.array_join(F.slice(tokens, e["at"] + 2, e["close"] - e["at"] - 1), ""))

    return let(F.array_min(F.concat(*[_found(tags, s, end) for s in selectors])), content)
