"""Worked examples, negative cases and policy invariants."""

from collections import Counter
import re
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import documents as dc
from tessera.operators import gallery, logs, norms, policy, search, tools
from tessera.plans import catalog, scan
from tessera.sources import files, segments, sinks
from tessera.streaming import logs as stream

SF = "/root/testdata/sf0.001"


def docs(spark, rows, schema="id long, path string, project string, text string"):
    return spark.createDataFrame(rows, schema)


def test_wildcards(spark):
    names = ["Privat", "Fotos privat", "Privatrechnung 2025.pdf", "Personaldossiers", "Personalliste.xlsx", "Lohnabrechnung Mai.pdf", "Lohn und Spesen"]
    others = ["Plan.pdf", "100%_a", "x/y"]
    d = docs(spark, [(i, f"/p/{n}/f.txt" if i % 2 else f"/p/{n}", "p", "") for i, n in enumerate(names + others)])
    kept = {r.path for r in policy.excluded(d, ["*Privat*", "*Personal*", "*Lohn*"]).collect()}
    assert kept == {f"/p/{n}/f.txt" if i % 2 else f"/p/{n}" for i, n in enumerate(names + others) if n in others}
    assert policy.excluded(d, ["*%*"]).count() == len(names + others) - 1 and policy.excluded(d, ["_"]).count() == len(names + others) and policy.excluded(d, []).count() == len(names + others)


def test_nothing_hidden_leaks(spark):
    p = policy.Policy(approved=["a"], blocked=["/a/secret"], ignored={"a": ["/a/old"]}, patterns=["*privat*"])
    d = docs(spark, [(1, "/a/x.txt", "a", "wand"), (2, "/a/secret/y.txt", "a", "wand"), (3, "/b/z.txt", "b", "wand"), (4, "/a/old/q.txt", "a", "wand"), (5, "/a/Privat/r.txt", "a", "wand"), (6, "/a/secrets.txt", "a", "wand"), (7, None, "a", "wand"), (8, "/n", None, "wand")])
    seen = policy.visible(d, p)
    assert {r.id for r in seen.collect()} == {1, 6}
    assert {r.id for r in search.search(search.build_index(seen), "Wand").collect()} == {1, 6}
    assert {r.name for r in dc.list_folder(seen, "/a").collect()} == {"x.txt", "secrets.txt"}
    assert dc.resolve_ids(seen, [1, 2, 3]).count() == 1 and policy.blocked_count(d, p).first().blocked == 1


def test_search(spark):
    d = docs(spark, [(1, "/1", "a", "Treppen-Haus aus Beton"), (2, "/2", "a", "Beton beton Beton"), (3, "/3", "b", "Holz"), (4, "/4", "b", None), (5, "/5", "b", "")])
    index = search.build_index(d)
    assert [r.id for r in search.search(index, "beton").collect()] == [2, 1]
    assert [r.id for r in search.search(index, "Haus").collect()] == [1] and search.search(index, "beton haus", "all").count() == 1
    assert search.search(index, "nichts").count() == 0 and search.hit_count(index, "beton holz").first().hits == 3
    [r] = search.with_excerpts(search.search(index, "haus"), d.withColumn("name", F.lit("n")), "haus", marked=True).collect()
    assert r.excerpt == "Treppen-<mark>Haus</mark> aus Beton"
    plan = search.search(index, "beton")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_excerpt(spark):
    text = "x " * 100 + "Ziel und Ziel" + " y" * 200
    r = docs(spark, [(1, "/", "a", text)]).select(tx.excerpt(F.col("text"), ["ziel"]).alias("e"), tx.highlight(F.lit("Ziel ziel Ziele"), ["ziel"]).alias("h")).first()
    assert len(r.e) == 220 and r.e[60:64] == "Ziel" and r.h == "<mark>Ziel</mark> <mark>ziel</mark> Ziele"


def test_blocks(spark):
    got = dc.read_blocks(docs(spark, [(1, "/", "a", "é" * 16001), (2, "/", "a", ""), (3, "/", "a", None)])).collect()
    assert [(r.id, r.block_no, len(r.text)) for r in sorted(got, key=str)] == [(1, 0, 8000), (1, 1, 8000), (1, 2, 1)]


def test_selections(spark):
    d = docs(spark, [(i, f"/{i}", "a", str(i), e) for i, e in enumerate(["pdf", "txt", "pdf", "pdf"])], "id long, path string, project string, text string, ext string")
    assert [tuple(r) for r in dc.merge_selection(d, [3, 1, 0]).orderBy("position").collect()] == [(1, 3, "/3"), (2, 0, "/0")]
    assert [r.id for r in dc.copy_selection(d, [2, 1]).orderBy("position").collect()] == [2, 1]
    assert dc.top_per_project(d, F.desc("id")).first().id == 3


def test_norms(spark):
    rows = [("SIA 118:2013", "current"), ("SIA 261:2014", "outdated"), ("VSS 40 050:2019", "current"), ("DIN 276:2018", "unchecked"), ("SIA 999:2001", "unchecked"), ("SIA 118", "unchecked"), ("none", "unchecked")]
    cat = norms.catalogue_of(spark, [("VSS", "40 050", 2019), ("SIA", "118", 2013), ("SIA", "118", 1991), ("SIA", "261", 2014), ("SIA", "261", 2020), ("DIN", "276", 2018)])
    d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "id int, text string")
    got = {r.id: r.status for r in norms.validity(norms.designations(d), cat).collect()}
    assert all(got[i] == s for i, (_, s) in enumerate(rows) if s)
    assert {r.status: r.n for r in norms.summary(norms.validity(norms.designations(d), cat)).collect()}["current"] == 2


def test_norms_that_are_missed_on_purpose(spark):
    filler = "Text. " * 200
    d = spark.createDataFrame([(1, "© SIA Zürich, alle Rechte " + filler), (2, filler + "Urheberrecht: VSS"), (3, filler + "© SIA" + filler), (4, filler)], "id int, text string")
    assert {r.id for r in d.where(norms.is_norm(F.col("text"), norms.publisher_notice())).collect()} == {1, 2}
    hits = d.select("id", F.lit("x").alias("excerpt"), norms.is_norm(F.col("text"), norms.publisher_notice()).alias("norm"))
    assert {r.id: r.excerpt for r in norms.redacted(hits, F.col("norm")).collect()} == {1: None, 2: None, 3: "x", 4: "x"}
    assert norms.redacted(hits, F.col("norm"), True).where("excerpt IS NULL").count() == 0


def test_gallery(spark):
    photos = spark.createDataFrame(catalog.PHOTOS, "id int, rating int, tags array<string>")
    assert {r.id for r in gallery.filtered(photos, 3).collect()} == {1, 3, 4, 6}
    assert {r.id for r in gallery.filtered(photos, 3, "Fassade").collect()} == {3, 4, 6} and gallery.filtered(photos).count() == 12
    assert {r.id for r in gallery.filtered(gallery.rated(photos, gallery.filtered(photos, tag="Dach"), 5), 5).collect()} == {6, 11}
    with pytest.raises(ValueError):
        gallery.rated(photos, photos, 6)


def test_logs(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    assert "user_id" not in logs.anonymous(events).columns
    sinks.append_log(logs.anonymous(events), str(tmp_path / "log"))
    sinks.append_log(logs.anonymous(events).limit(0), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == events.count()
    assert logs.retained(events, "2024-01-31 00:00:00", logs.SEARCH_DAYS).count() == events.count() and logs.retained(events, "2030-01-01 00:00:00", logs.ACCESS_DAYS).count() == 0
    plan = logs.retained(events, "2024-01-31 00:00:00", 14)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan


def test_stream(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    counts = stream.hourly_counts(stream.read_events(spark, f"{SF}/event*.parquet", events.schema))
    q = counts.writeStream.outputMode("complete").format("memory").queryName("hourly").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.start, r.event_type): r.n for r in spark.table("hourly").collect()}
    want = {(r.start, r.event_type): r["count"] for r in events.groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("start"), "event_type").count().collect()}
    assert got == want


def test_sources_and_index(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/a.txt").write_text("Beton Wand")
    (tmp_path / "in/sub/b.eml").write_bytes(b"From: a@b.c\r\nSubject: Plan\r\nDate: Mon, 01 Jan 2024 10:00:00 +0100\r\nContent-Type: text/plain\r\n\r\nDie Wand steht.\r\n")
    (tmp_path / "in/sub/c.eml").write_bytes(b"no header")
    found = files.scan_folders(spark, [str(tmp_path / "in")])
    assert {(r.name, r.ext) for r in found.collect()} == {("a.txt", "txt"), ("b.eml", "eml"), ("c.eml", "eml")}
    assert files.plain_text(found).first().text == "Beton Wand"
    mail = {r.sender: r for r in files.read_mail(found.where("ext = 'eml'")).collect()}
    assert mail["a@b.c"].subject == "Plan" and mail["a@b.c"].sent_at.hour == 9 and mail[None].sent_at is None
    d = docs(spark, [(1, "/1", "a", "Beton Wand"), (2, "/2", "a", "Wand")])
    sinks.write_index(search.build_index(d), str(tmp_path / "index"))
    index = sinks.read_index(spark, str(tmp_path / "index"))
    assert [r.id for r in search.search(index, "wand").collect()] == [2, 1]
    assert "PushedFilters: [In(term" in search.matches(index, "wand beton")._jdf.queryExecution().executedPlan().toString()
    sinks.write_copies(dc.copy_selection(d, [2]), str(tmp_path / "copies"))
    assert spark.read.json(str(tmp_path / "copies")).first().path == "/2"


def test_ocr_route(spark):
    d = spark.createDataFrame([(1, "text", 210, 297), (2, " ", 210, 297), (3, None, 841, 594), (4, None, 840, 593)], "id int, text string, width_mm int, height_mm int")
    assert {r.id: r.route for r in files.ocr_route(d).collect()} == {1: "text", 2: "ocr", 3: "name_only", 4: "ocr"}


def test_entry_without_the_removable_part():
    import __spark_entry__ as e

    assert set(catalog.queries()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_queries_without_a_token_and_letters_that_change_length(spark):
    d = docs(spark, [(1, "/1", "a", "İİİ Wand und wand"), (2, "/2", "a", "!!!")])
    index = search.build_index(d)
    assert tx.query_terms("!!! _") == [] and search.search(index, "!!!").count() == 0 and search.hit_count(index, "").first().hits == 0
    assert search.with_excerpts(search.search(index, "!!!"), d.withColumn("name", F.lit("n")), "!!!", marked=True).count() == 0
    r = d.where("id = 1").select(tx.first_match(F.col("text"), ["wand"]).alias("at"), tx.highlight(F.col("text"), []).alias("same"), tx.first_match(F.col("text"), []).alias("none"), tx.first_match(F.col("text"), ["und"]).alias("und")).first()
    assert (r["at"], r["none"], r["und"]) == (5, 0, 10) and r["same"] == "İİİ Wand und wand"


def test_ai_tools_keep_policy_and_standards(spark):
    p = policy.Policy(approved=["a"], blocked=["/a/secret"])
    rows = [(1, "/a/x.txt", "a", "wand " * 3), (2, "/a/secret/y.txt", "a", "wand"), (3, "/b/z.txt", "b", "wand"), (4, "/a/n.txt", "a", "© SIA wand"), (5, "/a/t.txt", "a", None), (6, "/a/u.txt", None, "wand")]
    d = docs(spark, rows).withColumn("name", F.regexp_extract("path", "([^/]+)$", 1)).withColumn("ext", F.lit("txt"))
    entries = d.withColumn("norm", norms.is_norm(F.coalesce("text", F.lit("")))).withColumn("status", F.when(F.col("norm"), "outdated"))
    index = search.build_index(entries)
    found = {r.id: r for r in tools.find(index, d, p, "wand").collect()}
    assert set(found) == {1, 4} and found[4].excerpt is None and found[4].status == "outdated" and found[1].excerpt.startswith("wand")
    opted = {r.id: r for r in tools.find(index, d, p, "wand", norm_search=True).collect()}
    assert set(opted) == {1, 4} and "SIA" in opted[4].excerpt
    alone = search.build_index(entries.where("id IN (1, 4, 5)"))
    assert found[1].score == search.search(alone, "wand").where("id = 1").first().score
    for got in (tools.read_document(d, p), tools.merge(d, p, [4, 3, 2, 1], "txt"), tools.copy(d, p, [4, 3, 2, 1])):
        assert {r.id for r in got.collect()} == {1}
    assert {r.name for r in tools.list_folder(d, p, "/a").collect()} == {"x.txt", "t.txt"}
    assert {r.id for r in tools.resolve(d, p, [1, 2, 3, 4, 6]).collect()} == {1, 4}


def test_stored_index_is_read_by_term(spark):
    index = catalog._index(spark, SF)
    assert catalog._index(spark, SF).postings.inputFiles() == index.postings.inputFiles()
    plan = search.search(index, "license")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,license)" in plan or "PushedFilters: [In(term" in plan
    assert "documents.parquet" not in plan


def test_mails_keep_apart(spark):
    c = spark.createDataFrame([(0, 1000, "u", "x"), (1, 0, "u", "x"), (2**31, 5, "u", "x"), (7, None, "u", "x")], "conv_id long, turn long, role string, text string")
    got = files.mails_view(c).collect()
    assert len({r.id for r in got}) == 3 == len(got) and all(r.id < 0 for r in got)


def test_documents_without_source(spark):
    d = spark.createDataFrame([(1, "x", None, None), (2, "x", "de", "a")], "doc_id long, text string, lang string, source string")
    assert {r.path for r in files.documents_view(d).collect()} == {"/(none)/(none)/1.txt", "/a/de/2.txt"}
    assert policy.visible(files.documents_view(d), policy.Policy(approved=["(none)"])).count() == 1


def test_scan(spark, tmp_path):
    import io
    import zipfile

    root = tmp_path / "office"
    (root / "P1/Privat").mkdir(parents=True)
    (root / "P1/plan.txt").write_text("Beton Wand")
    (root / "P1/Privat/lohn.txt").write_text("Wand")
    (root / "P1/norm.txt").write_text("© SIA Zürich. Wand")
    (root / "P1/seite.html").write_text("<p>Wand</p><script>x</script>")
    (root / "P1/foto.jpg").write_bytes(b"\xff\xd8")
    (root / "P1/kaputt.xlsx").write_bytes(b"no archive")
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://x"><si><t>Wand</t></si></sst>')
    (root / "P1/liste.xlsx").write_bytes(raw.getvalue())
    (root / "P1/brief.eml").write_bytes(b"From: a@b.c\r\nSubject: Wand\r\nContent-Type: text/plain\r\n\r\nHallo\r\n")
    index = scan.scan(spark, [str(root)], str(tmp_path / "index"), patterns=["*privat*"])
    hits = {r.path: r for r in search.described(search.search(index, "wand"), index, "path", "project", "norm", "sender").collect()}
    assert set(hits) == {f"/P1/{n}" for n in ("plan.txt", "norm.txt", "seite.html", "liste.xlsx", "brief.eml")}
    assert hits["/P1/norm.txt"].norm and hits["/P1/plan.txt"].project == "P1" and hits["/P1/brief.eml"].sender == "a@b.c"
    assert search.search(index, "foto").count() == 1 and search.search(index, "kaputt").count() == 1


def test_choices_by_hand(spark):
    photos = spark.createDataFrame(catalog.PHOTOS, "id int, rating int, tags array<string>")
    twice = spark.createDataFrame([(3,), (3,)], "id int")
    assert gallery.tagged(photos, twice, "x").count() == 12 and gallery.rated(photos, twice, 1).count() == 12
    sheet = {r.id: (r.sheet, r.row, r.place) for r in gallery.contact_sheet(photos, 3, 2).collect()}
    assert sheet[1] == (1, 1, 1) and sheet[6] == (1, 2, 3) and sheet[7] == (2, 1, 1)


def test_rescan_reads_changed_files_only(spark, tmp_path, monkeypatch):
    root = tmp_path / "share"
    (root / "proj" / "sub").mkdir(parents=True)
    write = lambda name, text: (root / name).write_text(text)
    for i in range(5):
        write(f"proj/f{i}.txt", f"beam number{i}")
    write("proj/sub/page [1].html", "<p>beam in a page</p>")
    write("proj/privat.txt", "beam secret")
    index = segments.Segments(spark, str(tmp_path / "index"), 4)
    asked = []
    real = files.scan_folders
    monkeypatch.setattr(files, "scan_folders", lambda spark, folders, pattern="*": asked.append(list(folders)) or real(spark, folders, pattern))
    run = lambda: scan.rescan(spark, [str(root)], index, patterns=["*privat*"])
    hits = lambda q: sorted(r["path"] for r in search.described(search.search(index.open(), q, k=None), index.open(), "path").collect())
    assert run() == (6, 0, 0) and hits("beam") == [*(f"/proj/f{i}.txt" for i in range(5)), "/proj/sub/page [1].html"]
    asked.clear()
    write("proj/f1.txt", "column number1 changed")
    write("proj/sub/page [2].txt", "beam and column")
    (root / "proj/f0.txt").unlink()
    assert run() == (1, 1, 1)
    assert sorted(x.rpartition("/")[2] for x in asked[1]) == ["f1.txt", "page \\[2\\].txt"] or len(asked[1]) == 2
    assert hits("column") == ["/proj/f1.txt", "/proj/sub/page [2].txt"] and "/proj/f0.txt" not in hits("beam") and hits("secret") == []
    assert run() == (0, 0, 0)
    monkeypatch.setattr(scan, "FEW", 0)
    write("proj/f2.txt", "column again and again")
    assert run() == (0, 1, 0) and hits("again") == ["/proj/f2.txt"]


def test_catalogues_and_their_changes(spark, tmp_path):
    (tmp_path / "a.csv").write_text("publisher,number,year\nSIA,261,2014\nSIA,262,2013\nVSS,40 050,2019\nSIA,,2020\nSIA,9,old\n")
    (tmp_path / "b.csv").write_text("publisher,number,year\nSIA, 261 ,2020\nSIA,262,2013\nSIA,500,2024\nSIA,261,2014\n")
    old, new = (norms.read_catalogue(spark, str(tmp_path / f"{x}.csv")) for x in "ab")
    changes = norms.catalogue_changes(old, new)
    assert sorted(map(tuple, changes.select("publisher", "number", "before", "now", "change").collect())) == [("SIA", "261", 2014, 2020, "revised"), ("SIA", "500", None, 2024, "new"), ("VSS", "40 050", 2019, None, "withdrawn")]
    stored = spark.createDataFrame([(1, "SIA", "261", 2014), (2, "SIA", "261", 2020), (3, "VSS", "40 050", 2019), (4, "SIA", "262", 2003), (5, "SIA", "261", None)], "id long, publisher string, number string, year int")
    assert sorted(map(tuple, norms.affected(stored, changes).collect())) == [(1, "SIA", "261", "revised"), (3, "VSS", "40 050", "withdrawn")]


def test_terms_are_counted_where_the_text_is(spark):
    """Counting terms moves nothing and aggregates nothing, whatever a text holds; an index of parts holds the same."""
    texts = ["b a b", "", None, "!!", "Ä ä a9 9a a", "x", " ".join(f"w{i * i % 37}" for i in range(3000))]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    want = {(t, i, n) for i, x in enumerate(texts) for t, n in Counter(re.findall(r"[^\W_]+", (x or "").lower())).items()}
    index = search.build_index(docs)
    plan = index.postings._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan
    for found in (index, search.build_index(docs, parts=3)):
        assert {(r["term"], r["id"], r["tf"]) for r in found.postings.collect()} == want and found.postings.count() == len(want)
        assert {r["id"]: r["dl"] for r in found.entries.collect()} == {i: len(re.findall(r"[^\W_]+", x or "")) for i, x in enumerate(texts)}


def test_parts_grow_with_the_text(spark, monkeypatch, tmp_path):
    """A task sorts the postings of about PART bytes, so more text is more files and not larger ones."""
    monkeypatch.setattr(search, "PART", 4000)
    files = []
    for n in (40, 160):
        docs = spark.range(n).select("id", F.repeat(F.concat(F.lit("w"), F.col("id").cast("string"), F.lit(" ")), 50).alias("text"))
        sinks.write_index(search.build_index(docs, parts=search.parts_of(docs)), f"{tmp_path}/{n}")
        files.append(len(sinks.read_index(spark, f"{tmp_path}/{n}").postings.inputFiles()))
    assert files[1] >= 3 * files[0] > 3
    assert search.parts_of(docs.where("false")) == 1
