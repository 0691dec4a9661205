"""Personal data by patterns and by information-theoretic disclosure, in DataFrame operations only.

Base: four patterns over whole texts. Every value found is a protected entity. The method then asks
which other words of a document give an entity away once it is masked. Over the corpus, for entity e
and term t,

    PMI(t, e) = log(n_te * N / (n_t * n_e)),   IC(e) = log(N / n_e),

with document counts: n_te documents that mention e and hold t outside base spans, n_t documents that
hold t anywhere, n_e documents that mention e, N all documents. PMI / IC is 1 where t occurs nowhere
but with e.
Terms at GENERALISE or more are generalised to their kind, at REMOVE or more they are removed; fewer
than SUPPORT common documents are no evidence. A flagged term is touched everywhere in the documents
that mention its entity; texts without personal data stay as they are.

Data flow: one pass over the texts finds spans and writes them, with the texts that have any; pairs of
entities in SUPPORT documents or more (others cannot be evidence) and document counts are aggregated
map-side before their shuffle; entities and flagged terms are broadcast only if counted to be at most
SMALL, and joined by shuffle otherwise.

Defined results: null text counts as empty, without spans ('' and its SHA-256). Every row gives a
row, repeated rows and null doc_ids too. An empty table gives an empty result. Further columns are
ignored by the scan and kept by sanitise().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.native import BLOCK, let, matches, whole
from tessera.llm.shared import written
from tessera.session import table

KINDS = ("email", "ip", "card", "phone", "term")
#: A match may start where the last one ended or where no character of its first run stands before it; starts in between would be part of an earlier match. This keeps the search linear in runs of such characters.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[0-9]|[\x20-][0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTET = r"0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
WORD = r"[\p{L}\p{N}]+"
SUPPORT, GENERALISE, REMOVE, SMALL = 3, 0.8, 0.95, 200_000
SPAN = "struct<start:bigint,kind:int,end:bigint,value:string>"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0),
        lambda s, i: s + let(F.substr(digits, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1), lambda v: F.when(v > 9, v - 9).otherwise(v)),
    )
    return total % 10 == 0


def _valid_card(m: Column) -> Column:
    return let(_digits(m), lambda d: F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(F.lit(False)))


def _kinds(text: Column) -> list[tuple[Column, Column, Column]]:
    """Per kind: whether to search at all, pattern, and the test of a match."""
    digit = F.rlike(text, F.lit("[0-9]"))
    return [
        (F.contains(text, F.lit("@")), F.lit(EMAIL), lambda m: F.lit(True)),
        (F.rlike(text, F.lit(r"[0-9]\.[0-9]")), F.lit(IP), lambda m: F.rlike(m, F.lit(rf"^{OCTET}(?:\.{OCTET}){{3}}$"))),
        (digit, F.lit(CARD), _valid_card),
        (F.contains(text, F.lit("+")), F.lit(PHONE), lambda m: F.length(_digits(m)).between(9, 15)),
    ]


def mentions(text: Column) -> Column:
    """Base spans: array of (start, kind, end, value), sorted."""
    parts = []
    for n, (present, pattern, valid) in enumerate(_kinds(text)):
        value = F.lower if n < 2 else _digits
        kept = F.transform(_filtered(matches(text, pattern), valid), _row(n, value))
        none = F.expr("cast(array() as array<struct<start:bigint,kind:int,end:bigint,value:string>>)")
        parts.append(F.when(present, kept).otherwise(none))
    return F.sort_array(F.concat(*parts))


def _filtered(found: Column, valid) -> Column:
    return F.filter(found, lambda x: valid(x["m"]))


def _row(n: int, value):
    return lambda x: F.struct(x["start"].alias("start"), F.lit(n).alias("kind"), x["end"].alias("end"), value(x["m"]).alias("value"))


def _is_term(w: Column) -> Column:
    return (F.length(w) > 2) & ~F.rlike(w, F.lit("^[0-9]+$"))


def _entities() -> Column:
    return F.array_distinct(F.transform("spans", lambda s: F.concat(s["kind"].cast("string"), F.lit(":"), s["value"])))


def _rewritten(text: Column, spans: Column) -> Column:
    """text with sorted (start, end, by) replaced by `by`; of spans that overlap the first gives the replacement.

    Runs of BLOCK spans are cut out of their own stretch of the text, so a text with n spans is read n/BLOCK times, not n times.
    """
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / BLOCK).cast("int")), lambda b: F.slice(spans, b * BLOCK + 1, F.lit(BLOCK)))
    none, part = F.expr("cast(array() as array<string>)"), lambda t, a, n: F.substr(t, (a + 1).cast("int"), n.cast("int"))
    state = lambda out, pos: F.struct(out.alias("out"), pos.alias("pos"))

    def run(acc: Column, block: Column) -> Column:
        stretch = part(text, acc["pos"], F.greatest(F.array_max(F.transform(block, lambda s: s["end"])) - acc["pos"], F.lit(0)))
        return let(let(stretch, lambda t: F.aggregate(block, state(none, acc["pos"]), lambda a, s: one(t, acc["pos"], a, s))), lambda r: state(F.concat(acc["out"], F.array(F.array_join(r["out"], ""))), r["pos"]))

    def one(t: Column, origin: Column, acc: Column, s: Column) -> Column:
        fresh = F.concat(acc["out"], F.array(part(t, acc["pos"] - origin, s["start"] - acc["pos"]), s["by"]))
        return state(F.when(s["start"] >= acc["pos"], fresh).otherwise(acc["out"]), F.greatest(acc["pos"], s["end"]))

    whole_text = F.aggregate(blocks, state(none, F.lit(0).cast("long")), run, lambda acc: F.concat(F.array_join(acc["out"], ""), part(text, acc["pos"], F.length(text))))
    return F.when(F.size(spans) > 0, whole_text).otherwise(text)


def _evidence() -> Column:
    """Distinct terms of a text outside its base spans."""
    gaps = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(" ").alias("by")))
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(_rewritten(F.col("around"), gaps)), F.lit(WORD), F.lit(0)), _is_term))


def _places() -> Column:
    """Terms of a text: array of (term, start, end)."""
    words = F.transform(matches(F.col("around"), WORD), lambda w: F.struct(F.lower(w["m"]).alias("term"), w["start"].alias("start"), w["end"].alias("end")))
    return F.filter(words, lambda w: _is_term(w["term"]))


def scan(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """rid, doc_id, the columns in keep, spans (base), and around: the text where it has spans."""
    columns = dict.fromkeys(("doc_id", *keep))
    found = docs.select(F.monotonically_increasing_id().alias("rid"), *columns, whole(F.col("text")).alias("around"), mentions(whole(F.col("text"))).alias("spans"))
    return found.select("rid", *columns, "spans", F.when(F.size("spans") > 0, F.col("around")).alias("around"))


def _small(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= SMALL else rows


def disclosing(spark: SparkSession, docs: DataFrame, scanned: DataFrame) -> DataFrame:
    """(entity, term, share): terms that reveal an entity, with share = PMI / IC >= GENERALISE."""
    n = scanned.count()
    mentioned = scanned.where(F.size("spans") > 0)
    entities = mentioned.select(F.explode(_entities()).alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n_e")).where((F.col("n_e") >= SUPPORT) & (F.col("n_e") < n))
    entities = written(spark, entities, "pii-entities")
    both = mentioned.select(F.explode(_entities()).alias("entity"), "spans", "around").join(_small(entities.select("entity")), "entity", "left_semi")
    pairs = both.select("entity", F.explode(_evidence()).alias("term")).groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_te")).where(F.col("n_te") >= SUPPORT)
    pairs = written(spark, pairs, "pii-pairs")
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(whole(F.col("text"))), F.lit(WORD), F.lit(0)))).alias("term"))
    counts = words.groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    share = F.log(F.col("n_te") * F.lit(float(n)) / (F.col("n_t") * F.col("n_e"))) / F.log(F.lit(float(n)) / F.col("n_e"))
    return pairs.join(counts, "term").join(entities, "entity").select("entity", "term", share.alias("share")).where(F.col("share") >= GENERALISE)


def pii_scan(spark: SparkSession, docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """rid, doc_id, base (spans), terms (array of (start, kind, end, action)), and the columns in keep."""
    docs = docs.select(*dict.fromkeys(("doc_id", "text", *keep)))
    scanned = written(spark, scan(docs, keep), "pii-scan")
    flagged = written(spark, disclosing(spark, docs, scanned), "pii-flagged")
    near = scanned.where(F.size("spans") > 0).select("rid", "around", F.explode(_entities()).alias("entity")).join(_small(flagged.select("entity").distinct()), "entity", "left_semi")
    near = near.select("rid", "entity", F.explode(_places()).alias("t")).select("rid", "entity", "t.*")
    hit = _small(flagged).withColumnsRenamed({"entity": "f_entity", "term": "f_term"})
    near = near.join(hit, (F.col("entity") == F.col("f_entity")) & (F.col("term") == F.col("f_term")))
    action = F.when(F.max("share") >= REMOVE, "remove").otherwise("generalise")
    spans = near.groupBy("rid", "start", "end").agg(action.alias("action"))
    per_row = spans.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", F.lit(4).alias("kind"), "end", "action"))).alias("terms"))
    none = F.expr("cast(array() as array<struct<start:bigint,kind:int,end:bigint,action:string>>)")
    out = scanned.drop("around").withColumnRenamed("spans", "base").join(per_row, "rid", "left").withColumn("terms", F.coalesce("terms", none))
    outside = F.filter("terms", lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    return out.withColumn("terms", F.when((F.size("base") > 0) & (F.size("terms") > 0), outside).otherwise(none))


def _said(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat(names[s["kind"]], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))))


def digests(scanned: DataFrame) -> DataFrame:
    """doc_id, counts by kind, base_sha256, spans, n_removed, n_generalised, has_pii (any base span)."""
    count = lambda n: F.size(F.filter("base", lambda s: s["kind"] == n)).cast("long").alias(f"n_{KINDS[n]}")
    plain = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    done = lambda a: F.size(F.filter("terms", lambda t: t["action"] == a)).cast("long")
    return scanned.select(
        "doc_id",
        *(count(n) for n in range(4)),
        F.sha2(_said(F.col("base")), 256).alias("base_sha256"),
        _said(F.sort_array(F.concat(plain("base"), plain("terms")))).alias("spans"),
        done("remove").alias("n_removed"),
        done("generalise").alias("n_generalised"),
        (F.size("base") > 0).alias("has_pii"),
    )


def sanitise(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with text rewritten: base spans become <KIND>, generalised terms <WORD> or <NAME>, removed terms go. All columns stay."""
    columns = docs.columns
    scanned = pii_scan(spark, docs.select("doc_id", "text", F.struct(*(docs[c] for c in columns)).alias("row")), ("row",))
    text = whole(F.col("row.text"))
    said = lambda s: F.upper(F.concat(F.lit("<"), F.array(*map(F.lit, KINDS))[s["kind"]], F.lit(">")))
    cut = lambda s: F.substr(text, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
    base = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), said(s).alias("by")))
    terms = F.transform("terms", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["action"] == "remove", "").when(F.rlike(cut(s), F.lit(r"^\p{Lu}")), "<NAME>").otherwise("<WORD>").alias("by")))
    new = let(F.sort_array(F.concat(base, terms)), lambda spans: _rewritten(text, spans))
    put = F.when(F.size("base") > 0, new).otherwise(F.col("row.text"))
    return scanned.select(*(put.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in columns))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(pii_scan(spark, table(spark, sf_dir, "documents")))
