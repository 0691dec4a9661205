"""All registered queries of the library with the DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import documents as dc
from tessera.operators import gallery, logs, norms, policy, search, tools
from tessera.session import table
from tessera.sources import files, sinks

QUERY, K = "license und the", 20
TERMS = ("license", "und", "the")
NOW = "2024-01-31 00:00:00"
POLICY = policy.Policy(approved=[f"src{i}" for i in range(10)], blocked=["/src3", "/src5/de", "/src0/en/0.txt"], ignored={"src7": ["/src7/fr"]}, patterns=["*99*"])
IDS = [17, 3, 250, 42, 180, 5, 125, 206, 62, 1]
#: The twelve photos (tile, stars, tags) of the worked example.
PHOTOS = [(1, 3, ["Baustelle"]), (2, None, []), (3, 4, ["Fassade"]), (4, 4, ["Fassade"]), (5, None, []), (6, 4, ["Fassade", "Dach"]), (7, 1, []), (8, None, []), (9, 2, ["Fassade"]), (10, 2, []), (11, None, ["Dach"]), (12, None, [])]
#: Licence lines stand in for standards: (publisher, number, newest edition).
CHECKED = ("apache", "gpl", "cc")
CATALOGUE = [("apache", "license", 2), ("gpl", "license", 2), ("gpl", "license", 3), ("cc", "by-nc", 5)]


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return files.documents_view(table(spark, d, "documents"))


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


_INDEXES: dict[tuple, str] = {}


def _entries(spark: SparkSession, d: str) -> DataFrame:
    """Documents as the scan leaves them: with norm, and the status of standards against the catalogue. Both come from a document's own row, so texts do not move."""
    docs = _docs(spark, d).withColumn("norm", F.coalesce(norms.is_norm(F.col("text")) & F.col("id").isNotNull(), F.lit(False)))
    licence = F.when(F.col("norm"), F.struct(*_licence(F.col("text"))))
    known = norms.validity(docs.withColumn("licence", licence).select(*docs.columns, "licence.*"), norms.catalogue_of(spark, CATALOGUE), CHECKED, small=True)
    return known.withColumn("status", F.when(F.col("norm"), F.col("status"))).select(*[c for c in docs.columns if c != "norm"], "status", "norm")


def _mails(spark: SparkSession, d: str) -> DataFrame:
    return files.mails_view(table(spark, d, "conversations"))


def _everything(spark: SparkSession, d: str) -> DataFrame:
    """Documents and mails, with what is searched in all of them: path (folder and file names) and text."""
    mail = _mails(spark, d).select("id", "path", "project", "text", "sender", "sent_at")
    docs = _docs(spark, d).select("id", "path", "project", "text", F.lit(None).cast("string").alias("sender"), F.lit(None).cast("timestamp_ntz").alias("sent_at"))
    return docs.unionByName(mail).withColumn("found", F.concat_ws("\n", "path", "text"))


_SCANS = {"documents": (_entries, "text"), "names": (_docs, "path"), "everything": (_everything, "found")}


def listing(spark: SparkSession, d: str, tables: tuple[str, ...]) -> int:
    """A number that changes with the files of the tables: their paths, sizes and times, which are listed and not read."""
    names = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load([f"{d}/{t}.parquet" for t in tables])
    return names.agg(F.bit_xor(F.xxhash64("path", "length", "modificationTime"))).first()[0]


def _index(spark: SparkSession, d: str, kind: str = "documents") -> search.Index:
    """The stored index of a folder of tables, read again. It is written by the application's first search, its first scan, and again once the files of its tables have changed."""
    key = (spark.sparkContext.applicationId, d, kind, listing(spark, d, ("documents", "conversations") if kind == "everything" else ("documents",)))
    if key not in _INDEXES:
        path = sinks.home(spark)
        of, text = _SCANS[kind]
        docs = of(spark, d)
        sinks.write_index(search.build_index(docs, text, search.parts_of(docs, text)), path)
        _INDEXES[key] = path
    return sinks.read_index(spark, _INDEXES[key])


def search_topk(spark, d):
    index = _index(spark, d)
    return search.described(search.search(index, QUERY, k=K), index, "name", "path", "project")


def search_all_terms(spark, d):
    return search.search(_index(spark, d), QUERY, "all", K)


def search_hit_count(spark, d):
    return search.hit_count(_index(spark, d), QUERY)


def search_snippet(spark, d):
    return search.with_excerpts(search.search(_index(spark, d), QUERY, k=K), _docs(spark, d), QUERY)


def search_highlight(spark, d):
    return search.with_excerpts(search.search(_index(spark, d), QUERY, k=K), _docs(spark, d), QUERY, marked=True)


def search_compound(spark, d):
    """A hyphenated query is searched by its parts."""
    return search.search(_index(spark, d), "License-Und", "all", K)


def search_in_project(spark, d):
    index = _index(spark, d).restricted(lambda entries: entries.where(F.col("project") == "src4"))
    return search.search(index, QUERY, k=K)


def search_names(spark, d):
    """Search over file and folder names instead of contents."""
    return search.search(_index(spark, d, "names"), "src4 fr", "all", None)


def search_dated(spark, d):
    """Mails of a week, found by text or path."""
    index = _index(spark, d, "everything").restricted(lambda entries: entries.where((F.col("sent_at") >= F.lit("2024-01-05").cast("timestamp_ntz")) & (F.col("sent_at") < F.lit("2024-01-12").cast("timestamp_ntz"))))
    return search.described(search.search(index, "mail the", k=K), index, "path", "sender", "sent_at")


def filter_type(spark, d):
    return files.pages_view(table(spark, d, "pages")).where(F.col("ext").isin("html"))


def filter_date(spark, d):
    return _events(spark, d).where((F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2024-01-12").cast("timestamp_ntz"))).select("event_id", "ts")


def exclude_wildcard(spark, d):
    return policy.excluded(_docs(spark, d), ["*99*", "*SRC1?*", "d*"]).select("id", "path")


def exclude_folder(spark, d):
    return policy.without_ignored(_docs(spark, d), POLICY.ignored).select("id", "path")


def allow_folder(spark, d):
    return policy.allowed(_docs(spark, d), ["/src1", "/src2/en/"]).select("id", "path")


def ai_visible(spark, d):
    return policy.visible(_docs(spark, d), POLICY).select("id", "name", "path", "project")


def ai_search(spark, d):
    return tools.find(_index(spark, d), _docs(spark, d), POLICY, QUERY)


def ai_search_norms(spark, d):
    """The same for a reader who has opted into excerpts of standards, for a term that standards hold."""
    return tools.find(_index(spark, d), _docs(spark, d), POLICY, "license", norm_search=True)


def ai_projects(spark, d):
    """Projects that may be named at all, with their visible documents."""
    return policy.visible(_docs(spark, d), POLICY).groupBy("project").agg(F.count(F.lit(1)).alias("n"))


def log_block_count(spark, d):
    return policy.blocked_count(_docs(spark, d), POLICY)


def read_blocks(spark, d):
    return tools.read_document(_docs(spark, d), POLICY)


def list_folder(spark, d):
    docs = _docs(spark, d)
    return tools.list_folder(docs, POLICY, "/src5").unionByName(tools.list_folder(docs, POLICY, "/src4/en"))


def resolve_id(spark, d):
    return tools.resolve(_docs(spark, d), POLICY, IDS)


def copy_selection(spark, d):
    return tools.copy(_docs(spark, d), POLICY, IDS)


def merge_selection(spark, d):
    return tools.merge(_docs(spark, d), POLICY, IDS, "txt")


def top1_per_project(spark, d):
    return dc.top_per_project(_docs(spark, d).withColumn("n", F.length("text")), F.desc("n"), "id").select("project", "id", "n")


def norm_detect(spark, d):
    return _docs(spark, d).where(norms.is_norm(F.col("text"))).select("id", "path")


def norm_redacted_search(spark, d):
    index = _index(spark, d)
    hits = search.described(search.search(index, QUERY, k=K), index, "norm")
    return norms.redacted(search.with_excerpts(hits, _docs(spark, d), QUERY, ("name",)), F.col("norm")).drop("norm")


def norm_publishers(spark, d):
    """Standards by the publisher that their notice names; licence lines stand in, so their publishers do too."""
    named = F.regexp_extract("text", r"(?i)licensed? under (?:the |)(Apache|MIT|GNU|CC)\b", 1)
    rows = _docs(spark, d).where(norms.is_norm(F.col("text"), norms.publisher_notice(("Apache", "MIT", "GNU", "CC"))))
    return rows.groupBy(F.nullif(named, F.lit("")).alias("publisher")).agg(F.count(F.lit(1)).alias("n"))


def norm_search_misses(spark, d):
    """What detection misses on purpose: documents whose notice stands further than `window` from both ends; here a narrow window."""
    docs = _docs(spark, d).where(F.length("text") > 200)
    return docs.where(norms.is_norm(F.col("text")) & ~norms.is_norm(F.col("text"), window=20)).select("id")


def _licence(t):
    """publisher, number, year that a text's licence line gives."""
    kind = F.when(F.contains(t, F.lit("Apache License")), "apache").when(F.contains(t, F.lit("General Public License")), "gpl").when(F.contains(t, F.lit("CC BY-NC")), "cc").when(F.contains(t, F.lit("MIT License")), "mit")
    number = F.when(kind == "cc", "by-nc").otherwise("license")
    year = F.nullif(F.regexp_extract(t, r"(?i)(?:License, version |CC BY-NC )([0-9]+)", 1), F.lit("")).cast("int")
    return kind.alias("publisher"), number.alias("number"), year.alias("year")


def _licences(docs):
    return docs.select("id", *_licence(F.col("text")))


def norm_validity(spark, d):
    rows = _licences(_docs(spark, d).where(norms.is_norm(F.col("text"))))
    return norms.validity(rows, norms.catalogue_of(spark, CATALOGUE), CHECKED)


def norm_summary(spark, d):
    return norms.summary(norm_validity(spark, d))


def log_retention(spark, d):
    return logs.retained(logs.anonymous(_events(spark, d)), NOW, 14).select("event_id", "ts", "event_type")


def log_search_retention(spark, d):
    """Search logs are kept for 180 days."""
    return logs.retained(logs.anonymous(_events(spark, d)), "2024-07-13 00:00:00", logs.SEARCH_DAYS).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def catalogue_due(spark, d):
    """Catalogues (users stand in) whose last change-check is a week old or older."""
    return norms.due(_events(spark, d).withColumn("publisher", F.col("user_id").cast("string")), "2024-02-06 12:00:00")


def log_chars_sent(spark, d):
    return logs.access_totals(_events(spark, d), F.col("props"))


def daily_counts(spark, d):
    return logs.daily_counts(_events(spark, d))


def daily_counts_by_kind(spark, d):
    return logs.daily_counts(_events(spark, d), "event_type")


def expire_idle(spark, d):
    return logs.idle(_events(spark, d), "user_id", NOW, 5)


def min_group_publish(spark, d):
    return logs.published(_events(spark, d), "user_id")


def _photos(spark, d):
    return files.photos_view(table(spark, d, "pages"))


def gallery_filter(spark, d):
    return gallery.filtered(_photos(spark, d), 3, "en").select("id", "rating")


def gallery_tag(spark, d):
    photos = _photos(spark, d)
    return gallery.filtered(gallery.tagged(photos, gallery.filtered(photos, 2), "Auswahl"), 0, "Auswahl").select("id", F.size("tags").alias("n_tags"))


def gallery_sheet(spark, d):
    """The contact sheet of photos with four stars and more."""
    return gallery.contact_sheet(gallery.filtered(_photos(spark, d), 4))


def postings_build(spark, d):
    return search.build_index(_docs(spark, d)).postings.groupBy("term").agg(F.count(F.lit(1)).alias("docs"), F.sum("tf").alias("occurrences"))


def mail_threads(spark, d):
    """Exported mail: conversations as threads, with their first and last sender."""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("mails"), F.min_by("role", "turn").alias("first_sender"), F.max_by("role", "turn").alias("last_sender"))
    return c


def search_everything(spark, d):
    """One search over texts, file names and folder names of documents and mails; mails show sender and date."""
    index = _index(spark, d, "everything")
    return search.described(search.search(index, QUERY + " src4 mail", k=K), index, "path", "sender", "sent_at")


def format_tags(spark, d):
    return files.pages_view(table(spark, d, "pages")).groupBy("ext").agg(F.count(F.lit(1)).alias("n"))


def html_plain_text(spark, d):
    text = files.html_text(F.coalesce("html", F.lit("")))
    return table(spark, d, "pages").select("page_id", text.alias("text")).select("page_id", F.length("text").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


def ocr_route(spark, d):
    return files.ocr_route(files.sheets_view(table(spark, d, "documents"))).select("id", "route")


def norm_designation(spark, d):
    """Titles made of the documents' numbers, read back as publisher, number and year."""
    n = F.col("doc_id")
    publisher = F.element_at(F.array(*map(F.lit, ("SIA", "VSS", "SN EN", "DIN", "ISO"))), (n % 5 + 1).cast("int"))
    year = F.when(n % 3 != 0, F.concat(F.lit(":"), (1990 + n % 35).cast("string"))).otherwise(F.lit(""))
    number = F.when(n % 4 == 0, F.concat((10 + n % 80).cast("string"), F.lit(" 050"))).when(n % 4 == 1, F.concat((100 + n % 300).cast("string"), F.lit("/1"))).otherwise((100 + n % 300).cast("string"))
    title = F.when(n % 11 != 0, F.concat(F.lit("Norm "), publisher, F.lit(" "), number, year, F.lit(" Tragwerke"))).otherwise(F.lit("Plan"))
    return norms.designations(table(spark, d, "documents").select(n.alias("id"), title.alias("text"))).drop("text")


def log_anonymous(spark, d):
    """What an access log keeps: time and tool, nobody and no device."""
    return logs.anonymous(_events(spark, d)).select("event_id", "ts", "event_type", "value", "props")


def log_access_retention(spark, d):
    return logs.retained(_events(spark, d), "2025-01-15 00:00:00", logs.ACCESS_DAYS).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def gallery_rate(spark, d):
    """All visible photos chosen and given five stars."""
    photos = _photos(spark, d)
    return gallery.rated(photos, gallery.filtered(photos, 4), 5).select("id", "rating")


def gallery_tags(spark, d):
    return _photos(spark, d).select("id", F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def index_entries(spark, d):
    """What the stored index holds of each document."""
    return _index(spark, d).entries.select("id", "dl", "path", "norm", "status")


def gallery_example(spark, d):
    """The worked example among all photos: three stars and more, then the tag Fassade."""
    example = spark.createDataFrame(PHOTOS, "id int, rating int, tags array<string>")
    return gallery.filtered(_photos(spark, d).withColumn("id", F.col("id").cast("int")).unionByName(example), 3, "Fassade").select("id", "rating")


_RUNS = (
    search_topk, search_all_terms, search_hit_count, search_snippet, search_highlight, search_in_project, search_names, filter_type, filter_date,
    exclude_wildcard, exclude_folder, allow_folder, ai_visible, ai_search, ai_projects, log_block_count, read_blocks, list_folder, resolve_id,
    copy_selection, merge_selection, top1_per_project, norm_detect, norm_redacted_search, norm_validity, norm_summary, log_retention, log_chars_sent,
    daily_counts, daily_counts_by_kind, expire_idle, min_group_publish, gallery_filter, gallery_tag, postings_build, mail_threads,
    search_everything, format_tags, html_plain_text, ocr_route, norm_designation, log_anonymous, log_access_retention, gallery_rate, gallery_tags,
    search_compound, search_dated, ai_search_norms, norm_publishers, norm_search_misses, log_search_retention, catalogue_due, gallery_sheet, gallery_example,
    index_entries,
)


def queries() -> dict:
    return {f.__name__: f for f in _RUNS}


_VIEW = "v AS (SELECT doc_id AS id, doc_id || '.txt' AS name, '/' || coalesce(source, '(none)') || '/' || coalesce(lang, '(none)') || '/' || doc_id || '.txt' AS path, coalesce(source, '(none)') AS project, text FROM documents)"
_BELOW = lambda *folders: "(" + " OR ".join(f"starts_with(path || '/', '{f.rstrip('/')}/')" for f in folders) + ")"
_WILD = lambda *patterns: "(" + " OR ".join(f"len(list_filter(string_split(lower(path), '/'), lambda x: x LIKE '{tx.like_of(p)}' ESCAPE '\\')) > 0" for p in patterns) + ")"
_SHOWN = (
    f"w AS (SELECT * FROM v WHERE project IN ({', '.join(repr(p) for p in POLICY.approved)}) AND NOT {_BELOW(*POLICY.blocked)}"
    f" AND NOT (project = 'src7' AND {_BELOW('/src7/fr')}) AND NOT {_WILD(*POLICY.patterns)})"
)
_NORM = "regexp_matches(left(text, 500) || chr(10) || right(text, 500), '(?i)licen[sc]e|copyright|©|all rights reserved')"


def _bm25(source: str, having: str = "", terms=TERMS, limit: str = f"LIMIT {K}", text: str = "text") -> str:
    names = ", ".join(f"'{t}'" for t in terms)
    return f"""
tok AS (SELECT id, regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+') AS t FROM {source}),
len AS (SELECT id, len(t) AS dl FROM tok),
tot AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM len),
post AS (SELECT term, id, count(*) AS tf FROM (SELECT id, unnest(t) AS term FROM tok) WHERE term IN ({names}) GROUP BY ALL),
met AS (SELECT * FROM post WHERE id IN (SELECT id FROM post GROUP BY id {having})),
df AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM met, tot GROUP BY term, n),
hits AS (SELECT id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
         FROM met JOIN df USING (term) JOIN len USING (id), tot GROUP BY id ORDER BY score DESC, id {limit})"""


def _excerpt(text: str = "text", terms=TERMS) -> str:
    spaced = f"(' ' || regexp_replace(lower({text}), '[^\\p{{L}}\\p{{N}}]', ' ', 'g') || ' ')"
    at = ", ".join(f"nullif(instr({spaced}, ' {t} '), 0)" for t in terms)
    return f"substr({text}, greatest(1, coalesce(least({at}), 0) - 60), 220)"


def _marked(text: str) -> str:
    apart = f"regexp_replace({text}, '([^\\p{{L}}\\p{{N}}])', chr(1) || '\\1' || chr(1), 'g')"
    return f"replace(regexp_replace({apart}, '(?i)(^|' || chr(1) || ')({'|'.join(TERMS)})($|' || chr(1) || ')', '\\1<mark>\\2</mark>\\3', 'g'), chr(1), '')"


_VALID = """
n AS (SELECT doc_id AS id, text, CASE WHEN contains(text, 'Apache License') THEN 'apache' WHEN contains(text, 'General Public License') THEN 'gpl' WHEN contains(text, 'CC BY-NC') THEN 'cc' WHEN contains(text, 'MIT License') THEN 'mit' END AS publisher FROM documents WHERE """ + _NORM + """),
p AS (SELECT id, publisher, CASE WHEN publisher = 'cc' THEN 'by-nc' ELSE 'license' END AS number, CAST(nullif(regexp_extract(text, '(?i)(?:License, version |CC BY-NC )([0-9]+)', 1), '') AS INTEGER) AS year FROM n),
c AS (SELECT * FROM (VALUES ('apache', 'license', 2), ('gpl', 'license', 3), ('cc', 'by-nc', 5)) t(publisher, number, newest)),
s AS (SELECT publisher, number, id, year, CASE WHEN newest IS NULL OR year IS NULL THEN 'unchecked' WHEN year < newest THEN 'outdated' ELSE 'current' END AS status FROM p LEFT JOIN c USING (publisher, number))"""
_MAIL = "e AS (SELECT id, path, path || chr(10) || text AS text, NULL AS sender, CAST(NULL AS TIMESTAMP) AS sent_at FROM v UNION ALL SELECT -1 - ((conv_id + turn) * (conv_id + turn + 1) // 2 + turn), '/mail/' || conv_id || '/' || conv_id || '-' || turn || '.eml', '/mail/' || conv_id || '/' || conv_id || '-' || turn || '.eml' || chr(10) || text, role, TIMESTAMP '2024-01-01' + to_days(CAST(conv_id % 365 AS INTEGER)) + to_minutes(turn) FROM conversations)"
_PHOTOS = "ph AS (SELECT page_id AS id, CAST(CASE WHEN page_id % 7 < 6 THEN page_id % 7 END AS INTEGER) AS rating, list_filter([nullif(regexp_extract(url, '^[a-z]+://[^/]+/([^/?#]+)', 1), ''), CASE WHEN contains(url, 'source=feed') THEN 'feed' END], lambda t: t IS NOT NULL) AS tags FROM pages)"
_PAGES = "v AS (SELECT page_id AS id, regexp_extract(url, '^[a-z]+://[^/]+([^?#]*)', 1) AS path, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS project FROM pages), w AS (SELECT *, lower(regexp_extract(path, '\\.([^./?#]+)$', 1)) AS ext FROM v)"


def oracle_sql() -> dict[str, str]:
    ids = ", ".join(map(str, IDS))
    return {
        "search_topk": f"WITH {_VIEW}, {_bm25('v')} SELECT id, score, name, path, project FROM hits JOIN v USING (id)",
        "search_all_terms": f"WITH {_VIEW}, {_bm25('v', 'HAVING count(*) = 3')} SELECT * FROM hits",
        "search_hit_count": f"WITH {_VIEW}, {_bm25('v')} SELECT count(DISTINCT id) AS hits FROM met",
        "search_snippet": f"WITH {_VIEW}, {_bm25('v')} SELECT id, score, name, path, project, {_excerpt()} AS excerpt FROM hits JOIN v USING (id)",
        "search_highlight": f"WITH {_VIEW}, {_bm25('v')} SELECT id, score, name, path, project, {_marked(_excerpt())} AS excerpt FROM hits JOIN v USING (id)",
        "search_in_project": f"WITH {_VIEW}, w AS (SELECT * FROM v WHERE project = 'src4'), {_bm25('w')} SELECT * FROM hits",
        "search_names": f"WITH {_VIEW}, {_bm25('v', 'HAVING count(*) = 2', ('src4', 'fr'), '', 'path')} SELECT * FROM hits",
        "filter_type": f"WITH {_PAGES} SELECT * FROM w WHERE ext = 'html'",
        "filter_date": "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12'",
        "exclude_wildcard": f"WITH {_VIEW} SELECT id, path FROM v WHERE NOT {_WILD('*99*', '*SRC1?*', 'd*')}",
        "exclude_folder": f"WITH {_VIEW} SELECT id, path FROM v WHERE NOT (project = 'src7' AND {_BELOW('/src7/fr')})",
        "allow_folder": f"WITH {_VIEW} SELECT id, path FROM v WHERE {_BELOW('/src1', '/src2/en')}",
        "ai_visible": f"WITH {_VIEW}, {_SHOWN} SELECT id, name, path, project FROM w",
        "ai_search": f"WITH {_VALID}, {_VIEW}, {_SHOWN}, {_bm25('w')} SELECT id, score, name, path, project, status, CASE WHEN status IS NULL THEN {_excerpt()} END AS excerpt FROM hits JOIN w USING (id) LEFT JOIN (SELECT id, status FROM s) USING (id)",
        "ai_projects": f"WITH {_VIEW}, {_SHOWN} SELECT project, count(*) AS n FROM w GROUP BY project",
        "log_block_count": f"WITH {_VIEW} SELECT count(*) AS blocked FROM v WHERE project IN ({', '.join(repr(p) for p in POLICY.approved)}) AND {_BELOW(*POLICY.blocked)}",
        "read_blocks": f"WITH {_VIEW}, {_SHOWN} SELECT id, CAST(b AS INTEGER) AS block_no, substr(text, b * 8000 + 1, 8000) AS text FROM (SELECT id, text, unnest(range(CAST(ceil(length(text) / 8000.0) AS BIGINT))) AS b FROM w WHERE NOT {_NORM})",
        "list_folder": f"WITH {_VIEW}, {_SHOWN}, x AS (SELECT * FROM w WHERE NOT {_NORM}), y AS (SELECT substr(path, 7) AS r FROM x WHERE starts_with(path, '/src5/') UNION ALL SELECT substr(path, 10) FROM x WHERE starts_with(path, '/src4/en/')) SELECT DISTINCT split_part(r, '/', 1) AS name, CASE WHEN contains(r, '/') THEN 'folder' ELSE 'file' END AS kind FROM y",
        "resolve_id": f"WITH {_VIEW}, {_SHOWN} SELECT id, path FROM w WHERE id IN ({ids})",
        "copy_selection": f"WITH {_VIEW}, {_SHOWN} SELECT CAST(list_position([{ids}], id) AS BIGINT) AS position, id, path FROM w WHERE id IN ({ids}) AND NOT {_NORM}",
        "merge_selection": f"WITH {_VIEW}, {_SHOWN} SELECT row_number() OVER (ORDER BY list_position([{ids}], id)) AS position, id, path FROM w WHERE id IN ({ids}) AND NOT {_NORM}",
        "top1_per_project": f"WITH {_VIEW} SELECT project, id, CAST(length(text) AS INTEGER) AS n FROM v QUALIFY row_number() OVER (PARTITION BY project ORDER BY length(text) DESC, id) = 1",
        "norm_detect": f"WITH {_VIEW} SELECT id, path FROM v WHERE {_NORM}",
        "norm_redacted_search": f"WITH {_VIEW}, {_bm25('v')} SELECT id, score, name, CASE WHEN NOT {_NORM} THEN {_excerpt()} END AS excerpt FROM hits JOIN v USING (id)",
        "norm_validity": f"WITH {_VALID} SELECT * FROM s",
        "norm_summary": f"WITH {_VALID} SELECT status, count(*) AS n FROM s GROUP BY status",
        "log_retention": f"SELECT event_id, ts, event_type FROM events WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 14 DAY",
        "log_chars_sent": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS tool, count(*) AS calls, CAST(sum(length(props)) AS BIGINT) AS chars, CAST(sum(ceil(length(props) / 8000.0)) AS BIGINT) AS blocks FROM events GROUP BY ALL",
        "daily_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY ALL",
        "daily_counts_by_kind": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
        "expire_idle": f"SELECT user_id, max(ts) AS last FROM events GROUP BY user_id HAVING max(ts) < TIMESTAMP '{NOW}' - INTERVAL 5 HOUR",
        "min_group_publish": "SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) >= 5",
        "gallery_filter": f"WITH {_PHOTOS} SELECT id, rating FROM ph WHERE rating >= 3 AND list_contains(tags, 'en')",
        "gallery_tag": f"WITH {_PHOTOS} SELECT id, CAST(len(tags) + 1 AS INTEGER) AS n_tags FROM ph WHERE rating >= 2",
        "postings_build": f"WITH {_VIEW}, p AS (SELECT term, id, count(*) AS tf FROM (SELECT id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS term FROM v) GROUP BY ALL) SELECT term, count(*) AS docs, CAST(sum(tf) AS BIGINT) AS occurrences FROM p GROUP BY term",
        "search_everything": f"WITH {_VIEW}, {_MAIL}, {_bm25('e', '', (*TERMS, 'src4', 'mail'))} SELECT id, score, path, sender, sent_at FROM hits JOIN e USING (id)",
        "format_tags": f"WITH {_PAGES} SELECT ext, count(*) AS n FROM w GROUP BY ext",
        "html_plain_text": r"WITH t AS (SELECT page_id, trim(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>|<!--.*?-->|<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) AS x FROM pages) SELECT page_id, CAST(length(x) AS INTEGER) AS n_chars, md5(x) AS digest FROM t",
        "ocr_route": "SELECT doc_id AS id, CASE WHEN doc_id % 3 <> 0 AND trim(text) <> '' THEN 'text' WHEN least(210 + 105 * (doc_id % 7), 297 + 136 * (doc_id % 5)) >= 594 AND greatest(210 + 105 * (doc_id % 7), 297 + 136 * (doc_id % 5)) >= 841 THEN 'name_only' ELSE 'ocr' END AS route FROM documents",
        "norm_designation": "SELECT doc_id AS id, CASE WHEN doc_id % 11 <> 0 THEN ['SIA', 'VSS', 'SN EN', 'DIN', 'ISO'][CAST(doc_id % 5 + 1 AS INTEGER)] END AS publisher, CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 4 = 0 THEN (10 + doc_id % 80) || ' 050' WHEN doc_id % 4 = 1 THEN (100 + doc_id % 300) || '/1' ELSE CAST(100 + doc_id % 300 AS VARCHAR) END AS number, CAST(CASE WHEN doc_id % 11 <> 0 AND doc_id % 3 <> 0 THEN 1990 + doc_id % 35 END AS INTEGER) AS year FROM documents",
        "log_anonymous": "SELECT event_id, ts, event_type, value, props FROM events",
        "log_access_retention": "SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2025-01-15' - INTERVAL 365 DAY GROUP BY event_type",
        "gallery_rate": f"WITH {_PHOTOS} SELECT id, CASE WHEN rating >= 4 THEN 5 ELSE rating END AS rating FROM ph",
        "gallery_tags": f"WITH {_PHOTOS} SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM ph) GROUP BY tag",
        "mail_threads": "SELECT conv_id, count(*) AS mails, arg_min(role, turn) AS first_sender, arg_max(role, turn) AS last_sender FROM conversations GROUP BY conv_id",
        "search_dated": f"WITH {_VIEW}, {_MAIL}, w AS (SELECT * FROM e WHERE sent_at >= TIMESTAMP '2024-01-05' AND sent_at < TIMESTAMP '2024-01-12'), {_bm25('w', '', ('mail', 'the'))} SELECT id, score, path, sender, sent_at FROM hits JOIN w USING (id)",
        "search_compound": f"WITH {_VIEW}, {_bm25('v', 'HAVING count(*) = 2', ('license', 'und'))} SELECT * FROM hits",
        "ai_search_norms": f"WITH {_VALID}, {_VIEW}, {_SHOWN}, {_bm25('w', '', ('license',))} SELECT id, score, name, path, project, status, {_excerpt('text', ('license',))} AS excerpt FROM hits JOIN w USING (id) LEFT JOIN (SELECT id, status FROM s) USING (id)",
        "norm_publishers": "SELECT nullif(regexp_extract(text, '(?i)licensed? under (?:the |)(Apache|MIT|GNU|CC)\\b', 1), '') AS publisher, count(*) AS n FROM documents WHERE regexp_matches(left(text, 500) || chr(10) || right(text, 500), '(?is)(©|copyright|licen[sc]|urheber).{0,80}\\b(Apache|MIT|GNU|CC)\\b|\\b(Apache|MIT|GNU|CC)\\b.{0,80}(©|copyright|licen[sc]|urheber)') GROUP BY ALL",
        "norm_search_misses": f"WITH {_VIEW} SELECT id FROM v WHERE length(text) > 200 AND {_NORM} AND NOT {_NORM.replace('500', '20')}",
        "log_search_retention": "SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-07-13' - INTERVAL 180 DAY GROUP BY event_type",
        "catalogue_due": "SELECT CAST(user_id AS VARCHAR) AS publisher, max(ts) AS last FROM events GROUP BY ALL HAVING max(ts) <= TIMESTAMP '2024-01-30 12:00:00'",
        "gallery_sheet": f"WITH {_PHOTOS}, n AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS n FROM ph WHERE rating >= 4) SELECT id, CAST(n // 12 + 1 AS INTEGER) AS sheet, CAST(n // 3 % 4 + 1 AS INTEGER) AS row, CAST(n % 3 + 1 AS INTEGER) AS place FROM n",
        "gallery_example": "SELECT * FROM (VALUES (3, 4), (4, 4), (6, 4)) t(id, rating)",
        "index_entries": f"WITH {_VALID}, {_VIEW} SELECT id, CAST(len(regexp_extract_all(lower(v.text), '[\\p{{L}}\\p{{N}}]+')) AS BIGINT) AS dl, path, status IS NOT NULL AS norm, status FROM v LEFT JOIN (SELECT id, status FROM s) USING (id)",
    }
