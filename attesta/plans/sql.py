"""Pieces of oracle SQL (DuckDB) that several queries share."""

from __future__ import annotations

from attesta.functions.text import STOPWORDS

STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


def norm(x: str) -> str:
    return f"trim(regexp_replace(strip_accents(replace(lower({x}), 'ß', 'ss')), '[^a-z0-9]+', ' ', 'g'))"


def norm_ws(x: str) -> str:
    return f"replace(lower(trim(regexp_replace({x}, '\\s+', ' ', 'g'))), 'ß', 'ss')"


def tokens(x: str) -> str:
    """Significant tokens of an expression that is normal already."""
    return f"list_filter(string_split({x}, ' '), lambda t: length(t) >= 3 AND t NOT IN ({STOP}))"
