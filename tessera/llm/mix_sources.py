"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations only.

Leaves of a tree domain - language - source hold documents, counted in tokens (runs without white
space). A token budget goes down the tree: a node's budget is shared among its children by weight, and
what a child cannot use (its tokens times EPOCHS at most) is shared anew among its siblings by weight.
A node never gets more than its descendants can use, so a shortage leaves a parent only when all
siblings are full. The shares of a node have a closed form over its children in order of capacity per
weight, so each level is one window over the tree's nodes.

A leaf's budget is as many whole epochs as fit and a prefix of one more epoch. The order of that epoch
is md5 of seed, epoch, doc_id and text; the leaf's documents fall into buckets of about BUCKET
documents by the hash's leading bits, and only the bucket where the budget ends is ordered. So no
leaf, however large, is gathered or sorted, and texts do not move.

Defined results: null or blank texts have no tokens and are never taken. Null domain, lang or source is
the node "(none)". The last document of a leaf is taken in part: taken tells how many of its tokens,
and mixed() cuts its text there, with single blanks between tokens. Documents with equal hash, which
repeat doc_id and text, share equally what is taken of them. Budgets are whole tokens, rounded down a leaf. Clashing
columns are kept by mixed(). An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.native import let, whole
from tessera.llm.shared import written
from tessera.session import table

LEVELS = ("domain", "lang", "source")
#: Production parameters: share of all tokens to take, most epochs of a leaf, seed, weights (others have 1).
SHARE, EPOCHS, SEED = 0.5, 3, "mix-1"
WEIGHTS = {
    "domain": {"domain0": 3.0, "domain1": 2.0, "domain2": 2.0, "domain3": 1.0},
    "lang": {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 1.0},
    "source": {"src0": 2.0, "src1": 3.0},
}
BUCKET = 4096
#: Rows of the tree or of cut documents that may be broadcast, by a count made before; beyond it the join is a shuffle.
SMALL = 200_000


def domain_of(source: Column) -> Column:
    """The domain of a source: its number modulo four; sources without a number are in domain0."""
    digits = F.regexp_extract(source, "([0-9]{1,9})$", 1)
    return F.concat(F.lit("domain"), F.when(digits == "", F.lit(0)).otherwise(F.expr("try_cast(regexp_extract(source, '([0-9]{1,9})$', 1) as bigint)") % 4).cast("string"))


def keyed(docs: DataFrame, *more: Column) -> DataFrame:
    """LEVELS, doc_id, n_tokens, th (md5 of text) and more, of documents with tokens."""
    rows = docs.select(F.coalesce(domain_of(F.col("source")), F.lit("(none)")).alias("domain"), *(F.coalesce(c, F.lit("(none)")).alias(c) for c in ("lang", "source")), "doc_id", F.regexp_count(whole(F.col("text")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("n_tokens"), F.md5(whole(F.col("text")).cast("binary")).alias("th"), *more)
    return rows.where("n_tokens > 0")


def shared_out(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds column alloc to nodes (parent..., name, cap, weight, budget): the budget shared by weight, at most cap each, all of it while there is capacity."""
    ratio = F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).otherwise(F.lit(float("inf")))
    order = Window.partitionBy(*parent).orderBy(ratio, name)
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = nodes.withColumn("level", F.when(rest > 0, (F.col("budget") - before) / F.when(rest > 0, rest)).otherwise(F.lit(0.0)))
    full = F.col("cap") <= F.col("level") * F.col("weight")
    first = F.first(F.when(~full, F.col("level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return level.withColumn("open", first).withColumn("alloc", F.when(full, F.col("cap")).otherwise(F.greatest(F.lit(0.0), F.col("open") * F.col("weight")))).drop("level", "open")


def budgets(spark: SparkSession, leaves: DataFrame, total: float, epochs: int, weights: dict[str, dict[str, float]]) -> DataFrame:
    """LEVELS, tokens, n_docs, budget (whole tokens) of each leaf."""
    out = leaves.withColumn("cap", F.col("tokens") * F.lit(float(epochs)))
    given = F.lit(float(total))
    for k, name in enumerate(LEVELS):
        key = list(LEVELS[: k + 1])
        known = weights.get(name) or {"": 1.0}
        weight = F.coalesce(F.create_map(*(F.lit(x) for kv in known.items() for x in kv))[F.col(name)], F.lit(1.0))
        nodes = out.groupBy(*key).agg(F.sum("cap").alias("cap"), F.first("budget").alias("budget") if k else F.first(given).alias("budget")).withColumn("weight", weight)
        alloc = shared_out(nodes, key[:-1], name).select(*key, F.col("alloc").alias("budget"))
        out = out.drop("budget").join(alloc, key)
    return out.select(*LEVELS, "tokens", "n_docs", F.floor(F.col("budget") + 1e-6).cast("bigint").alias("budget"))


class Mix:
    """Which documents are taken, how often and how far."""

    def __init__(self, spark: SparkSession, docs: DataFrame, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED, weights: dict[str, dict[str, float]] | None = None):
        self.spark, self.seed = spark, seed
        self.light = written(spark, keyed(docs), "mix-docs")
        leaves = written(spark, self.light.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_docs")), "mix-leaves")
        total = leaves.agg(F.sum("tokens")).first()[0] or 0
        plan = budgets(spark, leaves, share * total, epochs, WEIGHTS if weights is None else weights)
        self.budgets = plan
        rest = F.col("budget") % F.col("tokens")
        plan = plan.select(*LEVELS, F.floor(F.col("budget") / F.col("tokens")).cast("int").alias("epochs"), rest.alias("rest"), F.ceil(F.col("n_docs") / BUCKET).alias("buckets"))
        self.plan = written(spark, plan, "mix-plan")
        ordered = self.placed(self.light, self.plan)
        sums = ordered.groupBy(*LEVELS, "rest", "bucket").agg(F.sum("n_tokens").alias("n"))
        upto = F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("bucket"))
        ends = sums.withColumn("upto", upto).where("upto >= rest AND upto - n < rest").select(*LEVELS, F.col("bucket").alias("last"), (F.col("upto") - F.col("n")).alias("before"))
        self.plan = written(spark, self.plan.join(ends, list(LEVELS), "left"), "mix-plan")
        cut = self.placed(self.light, self.plan).where("bucket = last")
        start = F.coalesce(F.sum("n_tokens").over(Window.partitionBy(*LEVELS).orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("before")
        cut = cut.withColumn("taken", F.greatest(F.lit(0), F.least(F.col("n_tokens"), F.col("rest") - start)))
        self.cut = written(spark, cut.groupBy(*LEVELS, "h").agg(F.floor(F.sum("taken") / F.count(F.lit(1))).cast("bigint").alias("taken")).where("taken > 0"), "mix-cut")

    def placed(self, rows: DataFrame, plan: DataFrame) -> DataFrame:
        """rows with their leaf's plan, h (their order in its last epoch) and bucket."""
        plan = F.broadcast(plan) if plan.count() <= SMALL else plan
        out = rows.join(plan, list(LEVELS))
        out = out.withColumn("h", F.md5(F.concat_ws(":", F.lit(self.seed), F.col("epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("th")).cast("binary")))
        return out.withColumn("bucket", F.shiftright(F.conv(F.substring("h", 1, 8), 16, 10).cast("bigint") * F.col("buckets"), 32))

    def taken(self, rows: DataFrame) -> DataFrame:
        """rows (of keyed), each once for every epoch it is taken in: with epoch and taken."""
        placed = self.placed(rows, self.plan)
        cut = self.cut.select(*(F.col(c).alias(f"c_{c}") for c in (*LEVELS, "h", "taken")))
        on = (F.col("bucket") == F.col("last")) & (F.col("h") == F.col("c_h")) & (F.col("domain") == F.col("c_domain")) & (F.col("lang") == F.col("c_lang")) & (F.col("source") == F.col("c_source"))
        met = placed.join(F.broadcast(cut) if cut.count() <= SMALL else cut, on, "left")
        part = F.when(F.col("bucket") < F.col("last"), F.col("n_tokens")).otherwise(F.coalesce("c_taken", F.lit(0)))
        last = F.when((F.col("rest") > 0) & (part > 0), F.array(F.struct(F.col("epochs").alias("epoch"), F.least(part, F.col("n_tokens")).alias("taken")))).otherwise(F.expr("cast(array() as array<struct<epoch:int,taken:bigint>>)"))
        full = F.transform(F.when(F.col("epochs") > 0, F.sequence(F.lit(0), F.col("epochs") - 1)).otherwise(F.expr("cast(array() as array<int>)")), lambda e: F.struct(e.alias("epoch"), F.col("n_tokens").alias("taken")))
        return met.withColumn("x", F.explode(F.concat(full, last))).withColumn("epoch", F.col("x.epoch")).withColumn("taken", F.col("x.taken"))


def mix_report(spark: SparkSession, docs: DataFrame, **parameters) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens, epoch, taken; a row for each document and epoch."""
    mix = Mix(spark, docs, **parameters)
    return mix.taken(mix.light).select("doc_id", *LEVELS, "n_tokens", "epoch", "taken")


def mixed(spark: SparkSession, docs: DataFrame, **parameters) -> DataFrame:
    """The mixture: the columns of docs, a row for each document and epoch; the last document of a leaf is cut."""
    columns = docs.columns
    mix = Mix(spark, docs, **parameters)
    rows = mix.taken(keyed(docs, F.struct(*(docs[c] for c in columns)).alias("row")))
    words = lambda t: F.filter(F.split(t, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    text = F.when(F.col("taken") == F.col("n_tokens"), F.col("row.text")).otherwise(let(words(F.col("row.text")), lambda w: F.array_join(F.slice(w, F.lit(1), F.col("taken").cast("int")), " ")))
    put = {"text": text}
    if "n_chars" in columns:
        put["n_chars"] = F.when(F.col("taken") == F.col("n_tokens"), F.col("row.n_chars")).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType))
    return rows.select(*(put[c].alias(c) if c in put else F.col(f"row.`{c}`") for c in columns))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(spark, table(spark, sf_dir, "documents"))


def _weight(name: str) -> str:
    return f"CASE {name} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS[name].items()) + " ELSE 1.0 END"


def _level(n: int) -> str:
    key, parent, name = ", ".join(LEVELS[:n]), ", ".join(LEVELS[: n - 1]), LEVELS[n - 1]
    part = f"PARTITION BY {parent}" if parent else ""
    source = f"(SELECT {key}, sum(tokens) * {EPOCHS}.0::DOUBLE AS cap, CAST({_weight(name)} AS DOUBLE) AS weight FROM leaf GROUP BY {key})"
    budget = f"{source} JOIN (SELECT {parent}, alloc AS budget FROM a{n - 1}) USING ({parent})" if parent else f"{source}, (SELECT {SHARE} * sum(tokens) AS budget FROM leaf)"
    return f"""
l{n} AS (SELECT *, (budget - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                 / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev
         FROM {budget} WINDOW o AS ({part} ORDER BY cap / weight, {name})),
a{n} AS (SELECT {key}, CASE WHEN cap <= lev * weight THEN cap ELSE greatest(0, weight *
           first_value(CASE WHEN cap > lev * weight THEN lev END IGNORE NULLS) OVER ({part} ORDER BY cap / weight, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) END AS alloc
         FROM l{n})"""


SQL = (
    rf"""
WITH d AS (
  SELECT doc_id, text, coalesce('domain' || coalesce(try_cast(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS BIGINT), 0) % 4, '(none)') AS domain,
         coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens, md5(coalesce(text, '')) AS th
  FROM documents
), t AS (SELECT * FROM d WHERE n_tokens > 0),
leaf AS (SELECT domain, lang, source, sum(n_tokens) AS tokens FROM t GROUP BY ALL),"""
    + ",".join(map(_level, (1, 2, 3)))
    + f""",
p AS (
  SELECT leaf.*, CAST(floor(alloc + 1e-6) AS BIGINT) AS budget FROM leaf JOIN a3 USING (domain, lang, source)
), o AS (
  SELECT t.*, CAST(budget // CAST(tokens AS BIGINT) AS INTEGER) AS epochs, budget % CAST(tokens AS BIGINT) AS rest,
         md5('{SEED}:' || (budget // CAST(tokens AS BIGINT)) || ':' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || th) AS h
  FROM t JOIN p USING (domain, lang, source)
), s AS (
  SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o
)
SELECT doc_id, domain, lang, source, n_tokens, CAST(e AS INTEGER) AS epoch,
       CAST(CASE WHEN e < epochs THEN n_tokens ELSE least(n_tokens, rest - before) END AS BIGINT) AS taken
FROM (SELECT *, unnest(range(epochs + 1)) AS e FROM s) WHERE e < epochs OR before < rest
"""
)
