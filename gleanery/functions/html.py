"""What a page's markup says: title, description, text, links, directives.

The expressions are built-in regular expressions over the whole markup. Markup
that isn't balanced is the business of ``dom_text``, an Arrow batch function over
the standard parser.
"""

from __future__ import annotations

from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from gleanery.functions.quality import SPACE

NO_TITLE = "No Title"
DESCRIPTION_LENGTH = 200
CONTENT_CAP = 100_000
_SPACE = SPACE + "+"
_UNSEEN = r"(?is)<!--.*?-->|<(script|style|template|noscript)\b.*?</\1\s*>"


#: Names of most references in pages and their characters, replaced without a look-up; the ampersand comes last.
_COMMON = ("nbsp", "lt", "gt", "quot", "apos", "copy", "middot", "hellip", "ndash", "mdash", "laquo", "raquo", "amp")
_REFERENCE = r"&(#[xX]?[0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);"
_RARE = rf"&(?!(?:{'|'.join(_COMMON)});)(?:#[xX]?[0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);"


def _table() -> str:
    """The standard's named references as one text of marked names and characters, which a plan holds as one value."""
    return "".join(f"\u0001{k[:-1]}\u0002{v}" for k, v in html5.items() if k.endswith(";")) + "\u0001"


def _numbered(code: Column, base: int) -> Column:
    """The character of a number in digits; the replacement character for none that exists."""
    value = F.conv(code, base, 10).cast("long")
    usable = (F.length(code) <= 8) & value.between(1, 0x10FFFF) & ~value.between(0xD800, 0xDFFF)
    return F.when(usable, F.decode(F.unhex(F.lpad(F.conv(code, base, 16), 8, "0")), "UTF-32")).otherwise(F.lit("\ufffd"))


def unescaped(x: Column) -> Column:
    """Character references resolved once, by name or number; unknown names stay.

    Texts with common names only are replaced name by name. Another text is cut at
    its ampersands, and each piece looks its name up.
    """
    common = x
    for name in _COMMON:
        common = F.replace(common, F.lit(f"&{name};"), F.lit(html5[f"{name};"]))
    table = F.lit(_table())

    def resolved(piece: Column, at: Column) -> Column:
        name = F.regexp_extract(F.concat(F.lit("&"), piece), "^" + _REFERENCE, 1)
        rest = F.substring(piece, F.length(name) + 2, F.length(piece))
        number = F.when(F.lower(F.substring(name, 1, 2)) == "#x", _numbered(F.substring(name, 3, F.length(name)), 16)).when(F.substring(name, 1, 1) == "#", _numbered(F.substring(name, 2, F.length(name)), 10))
        mark = F.concat(F.lit("\u0001"), name, F.lit("\u0002"))
        # what follows the name in the table, up to the next mark
        behind = F.element_at(F.split(F.substring(table, F.position(mark, table) + F.length(mark), F.lit(8)), "\u0001"), 1)
        found = F.coalesce(number, F.when(F.contains(table, mark), behind))
        return F.when(at == 0, piece).when((name == "") | found.isNull(), F.concat(F.lit("&"), piece)).otherwise(F.concat(found, rest))

    return F.when(~F.contains(x, F.lit("&")), x).when(~x.rlike(_RARE), common).otherwise(F.array_join(F.transform(F.split(x, "&"), resolved), ""))


def stripped(x: Column) -> Column:
    """``x`` without white space at its ends, Unicode's included."""
    return F.regexp_replace(x, f"^{_SPACE}|(?<!{SPACE}){_SPACE}$", "")


def _seen(markup: Column) -> Column:
    return F.regexp_replace(markup, _UNSEEN, "")


def title(markup: Column) -> Column:
    """The first title's text, ``No Title`` without one; an empty title stays empty."""
    found = F.regexp_extract(markup, r"(?is)<title[^>]*>(.*?)</title\s*>", 1)
    return F.when(markup.rlike(r"(?is)<title[^>]*>.*?</title\s*>"), stripped(unescaped(found))).otherwise(F.lit(NO_TITLE))


def pieces(markup: Column) -> Column:
    """Text nodes in order, stripped, without empty ones; scripts, styles and comments are no text."""
    # entities are resolved once the tags are gone, so that an escaped sign opens none
    nodes = F.split(unescaped(F.regexp_replace(_seen(markup), r"<[^>]*>", "\u0001")), "\u0001")
    return F.filter(F.transform(nodes, stripped), lambda n: n != "")


def text(markup: Column) -> Column:
    """All text of the page, title included, its pieces joined by one space."""
    return F.array_join(pieces(markup), " ")


def content(full: Column) -> Column:
    """The stored part of a text."""
    return F.substring(full, 1, CONTENT_CAP)


def _meta(markup: Column, attribute: str, name: str) -> Column:
    """content of the first meta element whose ``attribute`` is ``name``, '' if none."""
    tag = F.regexp_extract(markup, rf"(?is)<meta\b(?=[^>]*\b{attribute}\s*=\s*[\"']{name}[\"'])[^>]*>", 0)
    return stripped(unescaped(F.regexp_extract(tag, r"(?is)\bcontent\s*=\s*(?:\"([^\"]*)\"|'[^']*')", 1)))


def description(markup: Column, full: Column) -> Column:
    """The page's description, or its social one, or the start of its text."""
    start = F.when(F.length(full) > DESCRIPTION_LENGTH, F.concat(F.substring(full, 1, DESCRIPTION_LENGTH), F.lit("..."))).otherwise(full)
    return F.coalesce(F.nullif(_meta(markup, "name", "description"), F.lit("")), F.nullif(_meta(markup, "property", "og:description"), F.lit("")), start)


def word_count(full: Column) -> Column:
    """Words between white space, of the whole text."""
    return F.size(F.filter(F.split(full, _SPACE), lambda w: w != ""))


def hrefs(markup: Column) -> Column:
    """href of every anchor in order, repeats kept; empty ones and fragments are dropped."""
    found = F.regexp_extract_all(_seen(markup), F.lit(r"(?is)<a\b[^>]*?\bhref\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)"), F.lit(1))
    bare = F.transform(found, lambda h: F.regexp_replace(h, r"^[\"']|[\"']$", ""))
    plain = F.transform(bare, lambda h: F.trim(unescaped(h)))
    return F.filter(plain, lambda h: (h != "") & ~h.startswith("#"))


def canonical(markup: Column) -> Column:
    """href of the first canonical link element, '' if none."""
    tag = F.regexp_extract(markup, r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"'][^\"']*\bcanonical\b[^\"']*[\"'])[^>]*>", 0)
    return F.trim(unescaped(F.regexp_extract(tag, r"(?is)\bhref\s*=\s*[\"']([^\"']*)[\"']", 1)))


def directives(markup: Column, header: Column) -> Column:
    """Sorted robot directives of the header and of all robots meta elements, in lower case."""
    tags = F.regexp_extract_all(markup, F.lit(r"(?is)<meta\b(?=[^>]*\bname\s*=\s*[\"']robots[\"'])[^>]*\bcontent\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1))
    said = F.concat(tags, F.array(F.coalesce(header, F.lit(""))))
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(F.lower(F.array_join(said, ",")), ","), lambda d: F.trim(d)), lambda d: d != "")))


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "template", "noscript")

    def handle_endtag(self, tag):
        if tag in ("script", "style", "template", "noscript") and self.hidden:
            self.hidden -= 1

    def handle_data(self, data):
        if not self.hidden and data.strip():
            self.found.append(data.strip())


@F.pandas_udf(StringType())
def dom_text(markup: pd.Series) -> pd.Series:
    """The text by the tolerant parser, with every entity resolved; null for null."""

    def one(m):
        if m is None:
            return None
        p = _Text()
        p.feed(m)
        p.close()
        return " ".join(p.found)

    return pd.Series([one(m) for m in markup], dtype=object)
