"""Settings of a crawl from an INI file; values given at run time take precedence."""

from __future__ import annotations

import configparser
import re

from gleanery.functions.url import ACTION_PATHS, BLACKLIST, TRACKING_KEYS, TRACKING_PREFIXES, UrlRules
from gleanery.operators.frontier import FrontierRules


def listed(text: str | None, default: tuple[str, ...] = ()) -> tuple[str, ...]:
    """Items between pipes, commas or line breaks, stripped, empty ones dropped; the default for no text."""
    return default if text is None else tuple(p for p in (x.strip() for x in re.split(r"[|,\n]", text)) if p)


class Settings:
    """Values by name from all sections of a file, overridden by ``given``."""

    def __init__(self, path: str | None = None, **given):
        parser = configparser.ConfigParser(interpolation=None)
        if path:
            parser.read(path, encoding="utf-8")
        self.values = {k: v for section in parser.sections() for k, v in parser.items(section)} | {k: v for k, v in given.items() if v is not None}

    def number(self, name: str, default: float) -> float:
        """The value as a number, the default for none or no number."""
        try:
            return type(default)(float(self.values[name]))
        except (KeyError, TypeError, ValueError):
            return default

    def items(self, name: str, default: tuple[str, ...] = ()) -> tuple[str, ...]:
        value = self.values.get(name)
        return tuple(value) if isinstance(value, (list, tuple)) else listed(value, default)

    def url_rules(self) -> UrlRules:
        return UrlRules(self.items("action_path_keywords", ACTION_PATHS), self.items("blacklist_patterns", BLACKLIST), self.items("whitelisted_path_keywords"), self.number("max_query_strings", 5), self.number("max_url_path_depth", 5))

    def frontier_rules(self) -> FrontierRules:
        return FrontierRules(max_depth=self.number("max_crawl_depth", 6), pages_per_domain=self.number("max_pages_per_domain", 200), urls=self.url_rules())

    def tracking(self) -> tuple[tuple[str, ...], tuple[str, ...]]:
        return self.items("tracking_query_prefixes", TRACKING_PREFIXES), self.items("tracking_query_keys", TRACKING_KEYS)
