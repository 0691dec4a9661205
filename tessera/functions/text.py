"""Text functions of the search engine, all built-in expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+"
EXCERPT, LEAD = 220, 60


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits; parts of hyphenated compounds are tokens of their own."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def query_terms(query: str) -> list[str]:
    """The distinct tokens of a query, in order; none for a query without letters and digits."""
    return list(dict.fromkeys(re.findall(r"[^\W_]+", query.lower())))


def _any_token(terms: Sequence[str]) -> str:
    """A pattern of whole tokens among terms, in any case."""
    return rf"(?iu)(?<![\p{{L}}\p{{N}}])(?:{'|'.join(terms)})(?![\p{{L}}\p{{N}}])"


def first_match(text: Column, terms: Sequence[str]) -> Column:
    """Code point (from 1) of the first token among terms, 0 if there is none. Counted in the text as it is, as lower-casing may change its length."""
    if not terms:
        return F.lit(0)
    pieces = F.split(text, _any_token(terms), 2)
    return F.when(F.size(pieces) > 1, F.length(pieces[0]) + 1).otherwise(F.lit(0))


def excerpt(text: Column, terms: Sequence[str], size: int = EXCERPT, lead: int = LEAD) -> Column:
    """`size` code points that begin at most `lead` before the first match."""
    return F.substr(text, F.greatest(F.lit(1), first_match(text, terms) - lead), F.lit(size))


def highlight(text: Column, terms: Sequence[str]) -> Column:
    """text with <mark> around every token among terms, in any case."""
    return F.regexp_replace(text, _any_token(terms), "<mark>$0</mark>") if terms else text


def like_of(pattern: str) -> str:
    """The LIKE pattern of a wildcard pattern, in which only * is special."""
    for c in "\\%_":
        pattern = pattern.replace(c, f"\\{c}")
    return pattern.lower().replace("*", "%")
