"""Rules of visibility as a table, for more rules than a plan can hold as literals.

A rule is a row (kind, project, pattern):

  approve   project may be seen; all others are off
  block     pattern names a folder or file that nobody sees
  ignore    pattern names a folder or file that project leaves out
  wildcard  pattern with * that no file or folder name on the path may match, case aside

Folder rules meet the folders of documents in a hash join on path prefixes, wildcards meet names in a join on
a text that a match must hold; both look at each different folder and name once, however many documents
there are. What is hidden becomes keys, and documents are joined with these.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources import sinks

#: Hidden folders, files and names that may be broadcast, by a count made before; beyond it the join is a shuffle.
SMALL = 200_000
#: Letters of a text by which patterns are looked up.
LONGEST = 16
#: Names whose texts one task takes apart.
NAMES = 20_000
RULES = "kind string, project string, pattern string"


def _small(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.count() <= SMALL else keys


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def _prefixes(path: Column) -> Column:
    """"", /a, /a/b and /a/b/c of /a/b/c; the empty one stands for the root."""
    parts = F.split(path, "/", -1)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def _named(rules: DataFrame, kind: str) -> DataFrame:
    """The paths that rules of a kind name, without the slash at their end."""
    return rules.where(F.col("kind") == kind).select(F.regexp_replace("pattern", "/+$", "").alias("prefix"), F.col("project").alias("of")).distinct()


def hidden_paths(places: DataFrame, rules: DataFrame) -> DataFrame:
    """(project, place) of the places (project, place: paths of folders or files) that a block or ignore rule names or holds."""
    each = places.select("project", "place", F.explode(_prefixes(F.col("place"))).alias("prefix"))
    blocked = each.join(_named(rules, "block").select("prefix").distinct(), "prefix", "left_semi")
    ignore = _named(rules, "ignore")
    ignored = each.join(ignore, (each["prefix"] == ignore["prefix"]) & (each["project"] == ignore["of"]), "left_semi")
    return blocked.select("project", "place").unionByName(ignored.select("project", "place")).distinct()


def _grams(text: Column, n: int) -> Column:
    """All different stretches of n letters."""
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substr(text, i, F.lit(n))))).otherwise(F.expr("cast(array() as array<string>)"))


def _like(pattern: Column) -> Column:
    """The LIKE pattern of a wildcard, in which only * is special."""
    escaped = reduce(lambda x, c: F.replace(x, F.lit(c), F.lit("\\" + c)), "\\%_", F.lower(pattern))
    return F.replace(escaped, F.lit("*"), F.lit("%"))


def _keys(place: str, texts: Column) -> Column:
    return F.transform(texts, lambda x: F.struct(F.lit(place).alias("place"), x.alias("text")))


def _wanted(wild: Column) -> Column:
    """What a name must hold that a wildcard matches, as (place, text): all of it without a star, else its start, its end and what stands between stars. Long texts are cut; none for stars alone."""
    parts = F.split(wild, r"\*", -1)
    n = F.size(parts)
    real = lambda texts: F.filter(texts, lambda x: x != "")
    inner = _keys("in", F.transform(real(F.slice(parts, F.lit(2), F.greatest(n - 2, F.lit(0)))), lambda x: F.left(x, F.lit(LONGEST))))
    ends = F.concat(_keys("start", F.transform(real(F.array(parts[0])), lambda x: F.left(x, F.lit(LONGEST)))), _keys("end", F.transform(real(F.array(F.element_at(parts, -1))), lambda x: F.right(x, F.lit(LONGEST)))))
    return F.array_distinct(F.when(n == 1, _keys("all", F.array(wild))).otherwise(F.concat(ends, inner)))


def _held(name: Column, lengths: set[tuple[str, int]]) -> Column:
    """What a name holds of such keys, by the places and lengths that patterns ask for."""
    found = [_keys("all", F.array(name))]
    for place, n in sorted(lengths):
        cut = {"start": F.left(name, F.lit(n)), "end": F.right(name, F.lit(n))}.get(place)
        if place == "in":
            found.append(_keys(place, _grams(name, n)))
        elif cut is not None:
            found.append(_keys(place, F.when(F.length(name) >= n, F.array(cut)).otherwise(F.expr("cast(array() as array<string>)"))))
    return F.flatten(F.array(*found))


def matching_names(names: DataFrame, rules: DataFrame) -> DataFrame:
    """The names (name, lower-case) that a wildcard rule matches.

    A pattern is looked up by one text that a name must hold, whole, the one that fewest names hold: so a pattern
    meets about the names that it matches, and the work does not grow with names times patterns. LIKE decides. A
    pattern of stars alone matches every name.
    """
    patterns = rules.where("kind = 'wildcard'").select(F.lower("pattern").alias("wild"), _like(F.col("pattern")).alias("like")).distinct()
    keyed = patterns.select("like", _wanted(F.col("wild")).alias("keys"))
    wanted = sinks.stored(keyed.select("like", F.explode("keys").alias("key")).select("like", "key.*"))
    lengths = {(r["place"], r["n"]) for r in wanted.where("place <> 'all'").select("place", F.length("text").alias("n")).distinct().collect()}  # 3 * LONGEST at most
    names = names.repartition(max(1, -(-names.count() // NAMES)), "name")  # a small file of names is much work
    in_names = names.select("name", F.explode(_held(F.col("name"), lengths)).alias("key")).select("name", "key.*")
    met = sinks.stored(in_names.join(_small(wanted.select("place", "text").distinct()), ["place", "text"], "left_semi"))
    often = met.groupBy("place", "text").agg(F.count(F.lit(1)).alias("names"))
    # a pattern with a text that no name holds matches none
    best = F.min(F.struct(F.coalesce("names", F.lit(0)).alias("names"), "place", "text")).alias("best")
    rarest = wanted.join(often, ["place", "text"], "left").groupBy("like").agg(best).where("best.names > 0").select("like", "best.place", "best.text")
    found = met.join(rarest, ["place", "text"]).where(F.expr("name LIKE like")).select("name")
    every = keyed.where(F.size("keys") == 0).select(F.lit(True).alias("bare")).distinct()  # one row at most
    return found.unionByName(names.withColumn("bare", F.lit(True)).join(F.broadcast(every), "bare", "left_semi").select("name")).distinct()


def visible_by(docs: DataFrame, rules: DataFrame) -> DataFrame:
    """The rows of docs (path, project, more) that the rules show; equal to policy.visible() for the same rules. A null path or project is not shown."""
    rules = sinks.stored(rules.select("kind", "project", "pattern"))
    shown = docs.join(_small(rules.where("kind = 'approve'").select("project").distinct()), "project", "left_semi").where(F.col("path").isNotNull())
    last = F.element_at(F.split(F.lower("path"), "/", -1), -1)
    narrow = sinks.stored(shown.select("project", "path", _folder(F.col("path")).alias("place"), last.alias("name")))
    folders = sinks.stored(narrow.select("project", "place").distinct())
    by_folder = sinks.stored(hidden_paths(folders, rules))
    # files that are named themselves: one key a document, no prefixes
    ignore = _named(rules, "ignore")
    files = narrow.join(_named(rules, "block").select(F.col("prefix").alias("path")).distinct(), "path", "left_semi").select("project", "path")
    files = sinks.stored(files.unionByName(narrow.join(ignore, (narrow["path"] == ignore["prefix"]) & (narrow["project"] == ignore["of"]), "left_semi").select("project", "path")).distinct())
    of_folders = sinks.stored(folders.select("place", F.explode(F.split(F.lower("place"), "/", -1)).alias("name")).distinct())
    matched = sinks.stored(matching_names(sinks.stored(narrow.select("name").unionByName(of_folders.select("name")).distinct()), rules))
    by_name = sinks.stored(of_folders.join(matched, "name", "left_semi").select("place").distinct())
    out = shown.withColumn("_place", _folder(F.col("path"))).withColumn("_name", last)
    out = out.join(_small(by_folder.withColumnRenamed("place", "_place")), ["project", "_place"], "left_anti").join(_small(by_name.withColumnRenamed("place", "_place")), "_place", "left_anti")
    out = out.join(_small(files), ["project", "path"], "left_anti").join(_small(matched.withColumnRenamed("name", "_name")), "_name", "left_anti")
    return out.select(*docs.columns)
