"""Interval join: points with the ranges that hold them, by bins instead of a nested loop; and totals of these points without the pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, TimestampNTZType, TimestampType

from tessera.operators.asof import asof_join, buckets
from tessera.sources import sinks

#: A level of ranges joins the next wider one while that adds candidates for at most this share of all ranges.
SHARE = 0.1


def _axis(df: DataFrame, c: str) -> Column:
    """Times as microseconds, numbers as they are, in doubles."""
    timed = isinstance(df.schema[c].dataType, (DateType, TimestampType, TimestampNTZType))
    return (F.unix_micros(F.col(c).cast("timestamp")) if timed else F.col(c)).cast("double")


def levels(counts: dict[int, int], share: float = SHARE) -> dict[int, int]:
    """The level of bins that ranges of each length use: bins of level v are 2**v wide, a range of level v is at most that long.

    Every point is looked up once on each level, so rare lengths are moved to the next wider level, where a
    bin holds more points that their ranges do not: n * 2**steps of them, while that stays a small share.
    """
    total, out, rest = sum(counts.values()), {}, {}
    for v in sorted(counts):
        moved = {u: n * 2 ** (v - u) for u, n in rest.items()}
        if rest and sum(moved.values()) > share * total:
            top = max(rest)
            out |= dict.fromkeys(rest, top)
            rest = {}
        rest[v] = counts[v]
    return out | (dict.fromkeys(rest, max(rest)) if rest else {})


def interval_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, by: Sequence[str] = ()) -> DataFrame:
    """All pairs with low <= point < high and equal `by`: the columns of points and of ranges, which must differ but for `by`.

    Ranges go to bins about as wide as they are long, by levels of powers of two, so each takes two or three bins
    whatever the mixture of lengths; a point takes one bin a level, and a pair meets once. The levels come
    from a count of the ranges by length. Bins and `by` are an equi-join, whose skew Spark can split; the ends
    are checked exactly. Null and empty ranges hold nothing, null points and keys are in none.
    """
    size = _axis(ranges, high) - _axis(ranges, low)
    real = ranges.where(F.col(low) < F.col(high)).withColumn("_level", F.ceil(F.log2(size)).cast("int"))
    counts = {r["_level"]: r["n"] for r in real.groupBy("_level").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a power of two
    chosen = levels(counts) or {0: 0}  # without ranges there are no pairs, on any level
    level_of = F.create_map(*(F.lit(x) for pair in chosen.items() for x in pair))[F.col("_level")]
    bin_at = lambda x, level: F.floor(x / F.pow(F.lit(2.0), level)).cast("bigint")
    held = real.withColumn("_level", level_of).withColumn("_bin", F.explode(F.sequence(bin_at(_axis(ranges, low), F.col("_level")), bin_at(_axis(ranges, high), F.col("_level")))))
    at = _axis(points, point)
    probes = F.array(*(F.struct(F.lit(v).alias("_level"), bin_at(at, F.lit(v)).alias("_bin")) for v in sorted(set(chosen.values()))))
    asked = points.where(F.col(point).isNotNull()).withColumn("_at", F.explode(probes)).withColumns({"_level": F.col("_at._level"), "_bin": F.col("_at._bin")}).drop("_at")
    met = asked.join(held, [*by, "_level", "_bin"]).where((F.col(low) <= F.col(point)) & (F.col(point) < F.col(high)))
    return met.drop("_level", "_bin")


#: Measures that parts of a range can be merged by: of points, and of parts.
MERGED = {"count": (F.count, F.sum), "min": (F.min, F.min), "max": (F.max, F.max)}


def _numbered(ends: DataFrame, keys: Sequence[str]) -> DataFrame:
    """ends (keys, t: microseconds) with _n, their place (from 0) among those of their key, numbered within equally deep buckets of time."""
    bin_of, table = buckets(ends.select("t"))
    placed = ends.withColumn("bin", bin_of).join(F.broadcast(table), "bin").drop("bin")  # at most BINS rows
    before = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = placed.groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("size")).select(*keys, "bucket", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("first"))
    inside = F.row_number().over(Window.partitionBy(*keys, "bucket").orderBy("t")) - 1
    return placed.withColumn("inside", inside).join(first, [*keys, "bucket"]).select(*keys, "t", (F.col("first") + F.col("inside")).alias("_n"))


def interval_totals(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, measures: dict[str, tuple[str, Column]], by: Sequence[str] = ()) -> DataFrame:
    """The ranges that hold points of equal `by` (low <= point < high, times), with measures of these points: name -> (count, min or max, of what).

    No pair of a point and a range is made, so the work grows with points and ranges and not with their product. The
    ends of all ranges cut time into segments; an as-of join gives each point its segment. Segments are measured, then
    runs of 2, 4, 8 ... of them; a range of n segments is put together from 2 * log2(n) such runs at most, and equal
    ranges are put together once. Null and empty ranges hold nothing, null points and keys are in none.
    """
    keys = [f"_key_{i}" for i in range(len(by) or 1)]
    named = [F.col(b).alias(k) for b, k in zip(by, keys, strict=True)] if by else [F.lit(0).alias(keys[0])]
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    real = ranges.where(F.col(low) < F.col(high)).select(*named, micros(low).alias("_low"), micros(high).alias("_high"), F.struct(*ranges.columns).alias("_range")).dropna(subset=keys)
    both = real.select(*keys, F.explode(F.array("_low", "_high")).alias("t")).distinct()
    ends = sinks.stored(_numbered(both, keys))
    of_end = lambda t, n: ends.select(*keys, F.col("t").alias(t), F.col("_n").alias(n))
    spans = sinks.stored(real.select(*keys, "_low", "_high").distinct().join(of_end("_low", "_i"), [*keys, "_low"]).join(of_end("_high", "_j"), [*keys, "_high"]))
    top = (spans.agg(F.max(F.col("_j") - F.col("_i"))).first()[0] or 1).bit_length() - 1
    asked = points.select(*named, F.col(point).cast("timestamp").alias("_at"), *(c.alias(f"_of_{m}") for m, (_, c) in measures.items()))
    placed = asof_join(asked, ends.select(*keys, F.timestamp_micros("t").alias("_at"), "_n"), keys, "_at", ["_n"]).where("_n is not null")
    segments = placed.groupBy(*keys, "_n").agg(*(MERGED[kind][0](f"_of_{m}").alias(m) for m, (kind, _) in measures.items()))
    merged = [MERGED[kind][1](m).alias(m) for m, (kind, _) in measures.items()]
    runs = segments.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(top)))).withColumn("_run", F.expr("shiftright(_n, _level)")).groupBy(*keys, "_level", "_run").agg(*merged)
    first, end = "shiftright(_i + shiftleft(1L, v) - 1, v)", "shiftright(_j, v)"
    run = lambda odd, n: f"if({first} < {end} and {odd} % 2 = 1, named_struct('_level', v, '_run', {n}), null)"
    pieces = F.expr(f"inline(filter(flatten(transform(sequence(0, length(bin(_j - _i)) - 1), v -> array({run(first, first)}, {run(end, end + ' - 1')}))), x -> x is not null))")
    found = spans.select(*keys, "_low", "_high", pieces).join(runs, [*keys, "_level", "_run"]).groupBy(*keys, "_low", "_high").agg(*merged)
    return real.join(found, [*keys, "_low", "_high"]).select("_range.*", *measures)
