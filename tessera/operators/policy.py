"""Which documents a reader may see: folder rules, wildcard exclusions, approval, blocklist."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import like_of


def below(path: Column, folders: Sequence[str]) -> Column:
    """Whether path is one of the folders or lies below one."""
    tests = [F.startswith(F.concat(path, F.lit("/")), F.lit(f.rstrip("/") + "/")) for f in folders]
    return reduce(Column.__or__, tests, F.lit(False))


def matches_wildcard(path: Column, patterns: Sequence[str]) -> Column:
    """Whether the name of the file or of a folder above it matches a pattern; * stands for any text, case does not matter."""
    names = F.split(F.lower(path), "/", -1)
    tests = [_any_like(names, like_of(p)) for p in patterns]
    return reduce(Column.__or__, tests, F.lit(False))


def _any_like(names: Column, pattern: str) -> Column:
    return F.exists(names, lambda n: n.like(pattern))


def allowed(docs: DataFrame, folders: Sequence[str]) -> DataFrame:
    """Documents below released folders."""
    return docs.where(below(F.col("path"), folders))


def excluded(docs: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """Documents that no wildcard pattern excludes."""
    return docs.where(~matches_wildcard(F.col("path"), patterns))


def without_ignored(docs: DataFrame, ignored: dict[str, Sequence[str]]) -> DataFrame:
    """Documents outside the folders that their project ignores."""
    tests = [(F.col("project") == p) & below(F.col("path"), folders) for p, folders in ignored.items()]
    return docs.where(~F.coalesce(reduce(Column.__or__, tests, F.lit(False)), F.lit(False)))


@dataclass
class Policy:
    """Approved projects (all others are off), blocked folders or files, ignored folders by project, wildcard exclusions."""

    approved: Sequence[str] = ()
    blocked: Sequence[str] = ()
    ignored: dict[str, Sequence[str]] = field(default_factory=dict)
    patterns: Sequence[str] = ()


def visible(docs: DataFrame, policy: Policy) -> DataFrame:
    """What an AI reader may know of, before any projection, count or excerpt. Rules are literals, so they reach the scan."""
    shown = docs.where(F.col("project").isin(list(policy.approved)) & ~below(F.col("path"), policy.blocked))
    return excluded(without_ignored(shown, policy.ignored), policy.patterns)


def blocked_count(docs: DataFrame, policy: Policy) -> DataFrame:
    """How many approved documents the blocklist hides; only the number is told."""
    return docs.where(F.col("project").isin(list(policy.approved)) & below(F.col("path"), policy.blocked)).agg(F.count(F.lit(1)).alias("blocked"))
