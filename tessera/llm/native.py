"""Column helpers that stay inside the JVM: local bindings, match positions, word forms."""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Matches are placed in blocks of this many, so that a text with n matches copies n*n/BLOCK elements only.
BLOCK = 256
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WHITE = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def whole(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def spaced_words(text: Column) -> Column:
    """' w1 w2 ... wn ': the words of a text, A-Z lower-cased, between single blanks; a lone blank where there are none."""
    words = F.trim(F.regexp_replace(F.translate(whole(text), ascii_uppercase, ascii_lowercase), SEPARATORS, " "))
    return let(words, lambda w: F.when(w == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), w, F.lit(" "))))


def blanks(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


def matches(text: Column, pattern: Column | str, context: int = 0) -> Column:
    """All leftmost non-overlapping matches: array of (start, end, m, before, after), code points, end exclusive.

    The text between matches comes from split(), so starts are sums of lengths; before and after
    hold up to `context` code points next to the match, never reaching over another match.
    """
    p = F.lit(pattern) if isinstance(pattern, str) else pattern
    row = "struct<start:bigint,end:bigint,m:string,before:string,after:string>"

    def placed(block: Column, start: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            at = acc["pos"] + x["gap"]
            end = at + x["n"]
            return F.struct(F.concat(acc["out"], F.array(F.struct(at.alias("start"), end.alias("end"), x["m"].alias("m"), x["before"].alias("before"), x["after"].alias("after")))).alias("out"), end.alias("pos"))

        return F.aggregate(block, F.struct(F.expr(f"cast(array() as array<{row}>)").alias("out"), start.alias("pos")), step)["out"]

    def gaps(pieces: Column) -> Column:
        following = F.slice(pieces, F.lit(2), F.size(pieces))
        near = F.zip_with(pieces, following, lambda a, b: F.struct(F.length(a).cast("long").alias("gap"), (F.substring(a, -context, context) if context else F.lit("")).alias("before"), (F.substring(b, 1, context) if context else F.lit("")).alias("after")))
        found = F.zip_with(near, F.regexp_extract_all(text, p, F.lit(0)), lambda a, m: F.struct(a["gap"].alias("gap"), F.length(m).cast("long").alias("n"), m.alias("m"), a["before"].alias("before"), a["after"].alias("after")))
        return F.filter(found, lambda x: x["m"].isNotNull())

    def blocked(found: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / BLOCK).cast("int")), lambda b: F.slice(found, b * BLOCK + 1, F.lit(BLOCK)))
        return let(blocks, joined)

    def joined(blocks: Column) -> Column:
        total = lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda s, x: s + x["gap"] + x["n"])
        starts = F.aggregate(
            blocks,
            F.struct(F.expr("cast(array() as array<bigint>)").alias("out"), F.lit(0).cast("long").alias("pos")),
            lambda acc, b: F.struct(F.concat(acc["out"], F.array(acc["pos"])).alias("out"), (acc["pos"] + total(b)).alias("pos")),
        )["out"]
        return F.flatten(F.zip_with(blocks, starts, placed))

    none = F.expr(f"cast(array() as array<{row}>)")
    return let(let(F.split(text, p, -1), gaps), lambda found: F.when(F.size(found) > 0, blocked(found)).otherwise(none))
