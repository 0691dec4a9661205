"""Registered queries of AI readers, rule tables, text stores and segmented indexes, with the DuckDB SQL for the same rows."""

from __future__ import annotations

import dataclasses
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import norms, rules, search
from tessera.operators.reader import LOG, Reader
from tessera.plans import catalog
from tessera.plans.catalog import IDS, K, POLICY, QUERY
from tessera.session import table
from tessera.sources import files, segments, sinks, textstore

#: What a reader of documents and mails may see.
READER = dataclasses.replace(POLICY, approved=[*POLICY.approved, "mail"], blocked=[*POLICY.blocked, "/mail/3"])
ASKED = QUERY + " src4 mail"
NEEDED = ["id", "name", "path", "project", "text", "norm", "status", "sender", "sent_at"]
_STORED: dict[tuple, tuple[str, str]] = {}


def _all(spark: SparkSession, d: str) -> DataFrame:
    """Documents and mails with all that hits show, and found: what is searched of them."""
    docs = catalog._entries(spark, d).withColumns({"sender": F.lit(None).cast("string"), "sent_at": F.lit(None).cast("timestamp_ntz")})
    mails = files.mails_view(table(spark, d, "conversations")).withColumns({"norm": F.lit(False), "status": F.lit(None).cast("string")})
    return docs.select(*NEEDED).unionByName(mails.select(*NEEDED)).withColumn("found", F.concat_ws("\n", "path", "text"))


def _reader(spark: SparkSession, d: str, log: str | None = None) -> Reader:
    """A reader of the stored index and texts of a folder of tables; both are written once for each state of its files."""
    key = (spark.sparkContext.applicationId, d, catalog.listing(spark, d, ("documents", "conversations")))
    if key not in _STORED:
        index, texts = sinks.home(spark), sinks.home(spark)
        docs = _all(spark, d)
        sinks.write_index(search.build_index(docs, "found", search.parts_of(docs, "found")), index)
        textstore.write(docs.where("id is not null"), texts)
        _STORED[key] = index, texts
    index, texts = _STORED[key]
    return Reader(spark, sinks.read_index(spark, index), textstore.read(spark, texts), READER, log or sinks.home(spark))


def ai_find(spark, d):
    """AI search over texts and names of documents and mails, with sender and date."""
    return spark.createDataFrame(_reader(spark, d).find(ASKED, 100), "id long, score double, name string, path string, project string, sender string, sent_at timestamp_ntz, status string, excerpt string")


def _longest(reader: Reader) -> int:
    """The visible document with the most words; standards aside."""
    return reader._seen().where("not norm and id >= 0").orderBy(F.desc("dl"), "id").select("id").first()["id"]


def ai_read_block(spark, d):
    """The first and third block of the longest document that a reader may see."""
    reader = _reader(spark, d)
    doc_id = _longest(reader)
    return spark.createDataFrame(reader.read_document(doc_id) + reader.read_document(doc_id, 2), "id long, block_no int, text string")


def access_log(spark, d):
    """What a reader's calls leave in the access log, times aside."""
    reader = _reader(spark, d)
    reader.find(ASKED)
    reader.find("license")
    reader.read_document(_longest(reader))
    reader.read_document(3)
    reader.list_folder("/src4/en")
    reader.resolve(IDS)
    log = spark.read.schema(LOG + ", day date").parquet(reader.log)
    return log.select("tool", "query", "files", "chars", "blocks", "blocked")


def rules_of(docs: DataFrame) -> DataFrame:
    """A table of rules that grows with the documents: files, folders and wildcards that their ids and places give."""
    n = F.col("id")
    folder = F.regexp_replace("path", "/[^/]*$", "")
    rule = lambda when, kind, project, pattern: F.when(when, F.struct(F.lit(kind).alias("kind"), project.alias("project"), pattern.alias("pattern")))
    none = F.lit(None).cast("string")
    kinds = F.array(
        rule(F.regexp_extract("project", "([0-9]+)$", 1).try_cast("int") % 3 != 0, "approve", F.col("project"), none),
        rule(n % 7 == 0, "block", none, F.col("path")),
        rule(n % 211 == 5, "block", none, F.concat(folder, F.lit("/"))),
        rule(n % 307 == 11, "ignore", F.col("project"), folder),
        rule(n % 311 == 11, "ignore", F.lit("src1"), folder),
        rule(n % 10 == 3, "wildcard", none, F.concat(F.lit("*"), n.cast("string"), F.lit("7*"))),
        rule(n % 501 == 3, "wildcard", none, F.concat((n % 90 + 10).cast("string"), F.lit("*4.TXT"))),
        rule(n == 0, "wildcard", none, F.lit("*_*")),
    )
    return docs.select(F.explode(F.array_compact(kinds)).alias("rule")).select("rule.*").distinct()


def rules_visible(spark, d):
    """What a table of rules shows, with about as many rules as a third of the documents."""
    docs = files.documents_view(table(spark, d, "documents")).select("id", "path", "project")
    return rules.visible_by(docs, rules_of(docs))


def _listing(docs: DataFrame) -> DataFrame:
    return docs.select("path", "id", F.length("text").cast("long").alias("size"), (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(days=(F.col("id") % 28).cast("int"))).alias("modified"))


def index_incremental(spark, d):
    """Search after two scans and a merge: the second scan adds a tenth of the documents, drops a tenth and takes up changes of a tenth."""
    docs = files.documents_view(table(spark, d, "documents")).where("id is not null").withColumn("text", F.coalesce("text", F.lit("")))
    first = docs.where("id % 10 <> 3")
    second = docs.where("id % 10 <> 4").withColumn("text", F.when(F.col("id") % 10 == 5, F.concat("text", F.lit("\nLicense und the license"))).otherwise(F.col("text")))
    index = segments.Segments(spark, sinks.home(spark))
    for state in (first, second):
        index.update(_listing(state), lambda asked, state=state: state.join(segments.few(asked.select("id")), "id", "left_semi"))
    index.merge()
    now = index.open(tx.query_terms(QUERY))
    return search.described(search.search(now, QUERY, k=K), now, "path", "dl")


def mailbox_export(spark, d):
    """Conversations written as seven mailboxes and read back."""
    c = table(spark, d, "conversations")
    sent = F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(mins=(F.col("conv_id") + F.col("turn")).cast("int"))
    path = sinks.home(spark)
    sinks.write_mailboxes(c.select((F.col("conv_id") % 7).alias("box"), F.col("role").alias("sender"), F.concat_ws("-", "conv_id", "turn").alias("subject"), sent.alias("sent_at"), "text"), path)
    mails = files.read_mailboxes(spark, path)
    part = lambda i: F.split_part("subject", F.lit("-"), F.lit(i)).cast("long")
    return mails.select(part(1).alias("conv_id"), part(2).alias("turn"), "sender", F.date_format("sent_at", "yyyy-MM-dd HH:mm").alias("sent"), F.md5(F.col("text").cast("binary")).alias("digest"))


def catalogue_check(spark, d):
    """Stored standards that a change-check concerns, between two states of a catalogue: the editions that earlier and later documents name (licences stand in)."""
    found = catalog._licences(catalog._docs(spark, d).where(norms.is_norm(F.col("text")))).where("year is not null")
    number = F.concat("number", F.lit("-"), (F.col("id") % 5).cast("string"))
    stored = found.withColumn("number", number)
    old, new = stored.where("id % 4 < 2"), stored.where("id % 4 <> 0")
    return norms.affected(stored, norms.catalogue_changes(old, new))


_RUNS = (ai_find, ai_read_block, access_log, rules_visible, index_incremental, mailbox_export, catalogue_check)


def queries() -> dict:
    return {f.__name__: f for f in _RUNS}


def oracle_sql() -> dict[str, str]:
    below = catalog._BELOW
    view = catalog._VIEW
    everything = f"""{catalog._VALID}, {view},
x AS (SELECT v.id, name, path, project, coalesce(v.text, '') AS body, path || chr(10) || coalesce(v.text, '') AS text, status IS NOT NULL AS norm, status, NULL AS sender, CAST(NULL AS TIMESTAMP) AS sent_at FROM v LEFT JOIN (SELECT id, status FROM s) t ON t.id = v.id
 UNION ALL SELECT -1 - ((conv_id + turn) * (conv_id + turn + 1) // 2 + turn), conv_id || '-' || turn || '.eml', '/mail/' || conv_id || '/' || conv_id || '-' || turn || '.eml', 'mail', text, '/mail/' || conv_id || '/' || conv_id || '-' || turn || '.eml' || chr(10) || text, false, NULL, role, TIMESTAMP '2024-01-01' + to_days(CAST(conv_id % 365 AS INTEGER)) + to_minutes(CAST(turn AS BIGINT)) FROM conversations),
k AS (SELECT *, {below(*READER.blocked)} AS hidden FROM x WHERE project IN ({', '.join(repr(p) for p in READER.approved)}) AND NOT (project = 'src7' AND {below('/src7/fr')}) AND NOT {catalog._WILD(*READER.patterns)}),
w AS (SELECT * FROM k WHERE NOT hidden)"""
    terms = tuple(tx.query_terms(ASKED))

    def found(terms: tuple, name: str) -> str:
        """Hits of the terms, with their excerpts."""
        bm25 = catalog._bm25("w", terms=terms)
        for part in ("tok", "len", "tot", "post", "met", "df", "hits"):
            bm25 = re.sub(rf"\b{part}\b(?!\()", f"{part}_{name}", bm25)
        return f"{bm25}, f_{name} AS (SELECT id, score, name, path, project, sender, sent_at, status, CASE WHEN NOT norm THEN {catalog._excerpt('body', terms)} END AS excerpt FROM hits_{name} JOIN w USING (id))"

    def blocked(terms: tuple) -> str:
        return f"(SELECT count(*) FROM k WHERE hidden AND len(list_intersect(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), [{', '.join(repr(t) for t in terms)}])) > 0)"

    longest = "l AS (SELECT id, body FROM w WHERE NOT norm AND id >= 0 ORDER BY len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) DESC, id LIMIT 1)"
    ids = ", ".join(map(str, IDS))
    row = "SELECT '{}' AS tool, {} AS query, count(*) AS files, CAST(coalesce(sum(n), 0) AS BIGINT) AS chars, CAST(ceil(coalesce(sum(n), 0) / 8000.0) AS BIGINT) AS blocks, {} AS blocked FROM ({})"
    log = " UNION ALL ".join(
        (
            row.format("search", f"'{ASKED}'", blocked(terms), "SELECT length(excerpt) AS n FROM f_a"),
            row.format("search", "'license'", blocked(("license",)), "SELECT length(excerpt) AS n FROM f_b"),
            row.format("read_document", "(SELECT id || '/0' FROM l)", 0, "SELECT length(substr(body, 1, 8000)) AS n FROM l WHERE body <> ''"),
            row.format("read_document", "'3/0'", 0, "SELECT length(substr(body, 1, 8000)) AS n FROM w WHERE id = 3 AND NOT norm AND body <> ''"),
            row.format("list_folder", "'/src4/en'", 0, "SELECT DISTINCT split_part(substr(path, 10), '/', 1) AS name, length(split_part(substr(path, 10), '/', 1)) AS n FROM w WHERE NOT norm AND starts_with(path, '/src4/en/')"),
            row.format("open_file", f"'{ids.replace(' ', '')}'", 0, f"SELECT length(path) AS n FROM w WHERE id IN ({ids})"),
        )
    )
    rule = """ru AS (
 SELECT 'approve' AS kind, project, NULL AS pattern FROM v WHERE TRY_CAST(regexp_extract(project, '([0-9]+)$', 1) AS INTEGER) % 3 <> 0
 UNION SELECT 'block', NULL, path FROM v WHERE id % 7 = 0 UNION SELECT 'block', NULL, regexp_replace(path, '/[^/]*$', '') FROM v WHERE id % 211 = 5
 UNION SELECT 'ignore', project, regexp_replace(path, '/[^/]*$', '') FROM v WHERE id % 307 = 11 UNION SELECT 'ignore', 'src1', regexp_replace(path, '/[^/]*$', '') FROM v WHERE id % 311 = 11
 UNION SELECT 'wildcard', NULL, '%' || id || '7%' FROM v WHERE id % 10 = 3 UNION SELECT 'wildcard', NULL, (id % 90 + 10) || '%4.txt' FROM v WHERE id % 501 = 3 UNION SELECT 'wildcard', NULL, '%\\_%' FROM v WHERE id = 0)"""
    changed = "w AS (SELECT id, path, CASE WHEN id % 10 = 5 THEN coalesce(text, '') || chr(10) || 'License und the license' ELSE coalesce(text, '') END AS text FROM v WHERE id % 10 <> 4)"
    return {
        "ai_find": f"WITH {everything}, {found(terms, 'a')} SELECT * FROM f_a",
        "ai_read_block": f"WITH {everything}, {longest} SELECT id, CAST(b AS INTEGER) AS block_no, substr(body, b * 8000 + 1, 8000) AS text FROM (SELECT id, body, unnest([0, 2]) AS b FROM l) WHERE length(body) > b * 8000",
        "access_log": f"WITH {everything}, {found(terms, 'a')}, {found(('license',), 'b')}, {longest} {log}",
        "rules_visible": f"WITH {view}, {rule}"
        " SELECT id, path, project FROM v WHERE project IN (SELECT project FROM ru WHERE kind = 'approve') AND NOT EXISTS (SELECT 1 FROM ru WHERE kind = 'block' AND starts_with(v.path || '/', ru.pattern || '/'))"
        " AND NOT EXISTS (SELECT 1 FROM ru WHERE kind = 'ignore' AND ru.project = v.project AND starts_with(v.path || '/', ru.pattern || '/'))"
        " AND NOT EXISTS (SELECT 1 FROM ru, (SELECT unnest(string_split(lower(v.path), '/')) AS part) WHERE kind = 'wildcard' AND part LIKE lower(ru.pattern) ESCAPE '\\')",
        "catalogue_check": f"WITH {catalog._VALID}, f AS (SELECT id, publisher, number || '-' || (id % 5) AS number, year FROM p WHERE year IS NOT NULL), o AS (SELECT publisher, number, max(year) AS b FROM f WHERE id % 4 < 2 GROUP BY ALL), w AS (SELECT publisher, number, max(year) AS n FROM f WHERE id % 4 <> 0 GROUP BY ALL)"
        " SELECT id, f.publisher, f.number, CASE WHEN w.n IS NULL THEN 'withdrawn' ELSE 'revised' END AS change FROM f JOIN o ON o.publisher = f.publisher AND o.number = f.number LEFT JOIN w ON w.publisher = f.publisher AND w.number = f.number WHERE w.n IS NULL OR (w.n > o.b AND f.year < w.n)",
        "mailbox_export": "SELECT conv_id, turn, role AS sender, strftime(TIMESTAMP '2024-01-01' + to_minutes(CAST(conv_id + turn AS BIGINT)), '%Y-%m-%d %H:%M') AS sent, md5(coalesce(text, '')) AS digest FROM conversations",
        "index_incremental": f"WITH {view}, {changed}, {catalog._bm25('w')} SELECT id, score, path, dl FROM hits JOIN w USING (id) JOIN len USING (id)",
    }
