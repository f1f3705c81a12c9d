"""URL columns: parts, normal form, origin, filters, joins.

All but the resolution of relative paths and the escaping of unusual query
strings are built-in expressions. A malformed URL gives null, never an error.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Query keys and prefixes that only track visitors.
TRACKING_PREFIXES = ("utm_", "mc_")
TRACKING_KEYS = ("fbclid", "gclid", "igshid", "msclkid", "phpsessid", "ref", "ref_src", "session", "sessionid", "sid", "source")
# Parts of paths that act rather than show content.
ACTION_PATHS = ("/login", "/logout", "/signin", "/sign-in", "/signup", "/sign-up", "/register", "/vote", "/hide", "/reply", "/submit", "/cart", "/checkout")
# Path patterns not to visit.
BLACKLIST = ("/admin", "/backend", "/api/internal")

_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


@dataclass(frozen=True)
class UrlRules:
    """Limits and lists of the URL filter; an empty whitelist admits every path."""

    action_paths: tuple[str, ...] = ACTION_PATHS
    blacklist: tuple[str, ...] = BLACKLIST
    whitelist: tuple[str, ...] = ()
    max_query_items: int = 5
    max_path_depth: int = 5


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(F.trim(url), _PARTS, group)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def netloc(url: Column) -> Column:
    """Host, port and user as written; '' if there is none."""
    return _part(url, 2)


def path(url: Column) -> Column:
    return _part(url, 3)


def query(url: Column) -> Column:
    return _part(url, 4)


def is_web(url: Column) -> Column:
    """Whether the URL is absolute http or https with a host."""
    return scheme(url).isin("http", "https") & (netloc(url) != "")


def origin(url: Column) -> Column:
    """scheme://host of a web URL, null for others."""
    return F.when(is_web(url), F.concat(scheme(url), F.lit("://"), netloc(url)))


def domain_or_unknown(url: Column) -> Column:
    return F.coalesce(F.nullif(netloc(url), F.lit("")), F.lit("unknown"))


def _items(text: Column) -> Column:
    """Query items as structs of decoded key and value, in order; empty pieces are dropped."""
    pieces = F.filter(F.split(text, "&"), lambda p: p != "")
    decoded = lambda x: F.coalesce(F.try_url_decode(x), x)
    return F.transform(
        pieces,
        lambda p: F.struct(decoded(F.regexp_extract(p, "^([^=]*)", 1)).alias("k"), decoded(F.regexp_extract(p, "(?s)^[^=]*=(.*)$", 1)).alias("v")),
    )


def _encoded(x: Column) -> Column:
    """Form encoding that leaves ``_.-~`` and letters and digits of ASCII."""
    return F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _split(url: Column) -> Column:
    """Scheme in lower case, netloc, path and query as one array, by one match."""
    at = F.split(F.regexp_replace(F.trim(url), _PARTS, "$1\u0001$2\u0001$3\u0001$4"), "\u0001")
    return F.transform(at, lambda x, i: F.when(i == 0, F.lower(x)).otherwise(x))


def normalized(url: Column, prefixes: tuple[str, ...] = TRACKING_PREFIXES, keys: tuple[str, ...] = TRACKING_KEYS) -> Column:
    """The normal form of a web URL, null for others.

    Scheme and host in lower case without the default port; ``/`` for an empty path
    and no slashes at its end otherwise; no fragment; query items sorted without
    those that track.
    """
    tracking = "^(?:" + "|".join([*prefixes]) + ")"

    def form(at: Column) -> Column:
        kind, host, raw, items = (F.get(at, i) for i in range(4))
        short = F.regexp_replace(F.lower(host), F.when(kind == "http", ":80$").otherwise(":443$"), F.lit(""))
        bare = F.when(raw.isin("", "/"), F.lit("/")).otherwise(F.rtrim(raw, F.lit("/")))
        kept = F.filter(_items(items), lambda i: ~F.lower(i["k"]).isin(*keys) & ~F.lower(i["k"]).rlike(tracking))
        joined = F.array_join(F.transform(F.array_sort(kept), lambda i: F.concat(_encoded(i["k"]), F.lit("="), _encoded(i["v"]))), "&")
        tail = F.when(items == "", "").otherwise(F.when(joined != "", F.concat(F.lit("?"), joined)).otherwise(""))
        return F.when(kind.isin("http", "https") & (host != ""), F.concat(kind, F.lit("://"), short, bare, tail))

    return F.element_at(F.transform(F.array(_split(url)), form), 1)


def normalized_simple(url: Column) -> Column:
    """The form that maintenance compares: lower scheme and host, no slash at the end, no query or fragment."""
    bare = F.regexp_replace(path(url), "/+$", "")
    return F.when(is_web(url), F.concat(scheme(url), F.lit("://"), F.lower(netloc(url)), F.when(bare == "", F.lit("/")).otherwise(bare)))


def skipped(url: Column, rules: UrlRules = UrlRules()) -> Column:
    """Whether the rules keep the URL from being visited."""
    low = F.lower(path(url))
    quoted = lambda words: "|".join(r"\Q" + w + r"\E" for w in words)
    rule = low.rlike(quoted(rules.action_paths)) if rules.action_paths else F.lit(False)
    rule = rule | (F.size(F.filter(F.split(query(url), "&"), lambda p: p != "")) > rules.max_query_items)
    if rules.max_path_depth > 0:
        rule = rule | (F.size(F.filter(F.split(path(url), "/"), lambda p: p != "")) > rules.max_path_depth)
    if rules.whitelist:
        rule = rule | ~low.rlike(quoted(rules.whitelist))
    if rules.blacklist:
        rule = rule | url.rlike("|".join(rules.blacklist))
    return rule


@F.pandas_udf(StringType())
def _join(base: pd.Series, href: pd.Series) -> pd.Series:
    from urllib.parse import urljoin

    def one(b, h):
        try:
            return urljoin(b, h)
        except ValueError:
            return None

    return pd.Series([None if b is None or h is None else one(b, h) for b, h in zip(base, href)], dtype=object)


def resolved(base: Column, href: Column) -> Column:
    """``href`` as seen from ``base``; only relative paths with dots, and bare names, leave the built-in expressions."""
    h = F.trim(href)
    absolute = h.rlike("^[A-Za-z][A-Za-z0-9+.-]*:")
    rooted = h.rlike(r"^/(?!/)") & ~h.rlike(r"/\.{1,2}(/|$|[?#])")
    hosted = h.startswith("//")
    hard = ~(absolute | rooted | hosted)
    slow = _join(F.when(hard, base), F.when(hard, h))
    kind, host = F.lower(F.substring_index(base, ":", 1)), F.regexp_extract(base, "^[^:/?#]*://[^/?#]*", 0)
    return F.when(absolute, h).when(hosted, F.concat(kind, F.lit(":"), h)).when(rooted, F.concat(kind, F.substring(host, F.length(kind) + 1, F.length(host)), h)).otherwise(slow)


def present(url: Column) -> Column:
    """One row for a URL and none for null; as a generator it keeps the URL from being computed again in a filter."""
    return F.explode(F.array_compact(F.array(url)))
