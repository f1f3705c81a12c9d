"""Hosts and sites of pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def host_of_url(url: Column) -> Column:
    """The authority of an absolute URL without user, '' if it has none."""
    authority = F.regexp_extract(url, r"^[^:/?#]+://([^/?#]*)", 1)
    return F.regexp_replace(authority, r"^.*@", "")


def clean_host(host: Column) -> Column:
    """A host without letter case, surrounding space, port, final dots and a leading ``www.``."""
    low = F.lower(F.trim(host))
    bare = F.regexp_replace(F.regexp_replace(low, r":\d*$", ""), r"\.+$", "")
    return F.regexp_replace(bare, r"^www\.", "")


def site_of(domain: Column, url: Column) -> Column:
    """The site: of ``domain``, or of ``url`` where the domain is null, empty or ``unknown``."""
    own = clean_host(domain)
    usable = domain.isNotNull() & ~own.isin("", "unknown")
    return F.when(usable, own).otherwise(F.coalesce(clean_host(host_of_url(url)), F.lit("")))
