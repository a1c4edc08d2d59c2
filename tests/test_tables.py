"""Imports, progress, routing, export rows, file sources and the sweep."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from glosstream.operators import context, export, progress, route, stats, upsert
from glosstream.sources import files
from glosstream.streaming import sweep


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", 1), (3, "c", 2)], "k int, v string, n int")
    new = spark.createDataFrame([(1, "a", None), (2, "B", 1), (4, "d", None)], "k int, v string, n int")
    once = upsert.diff(old, new, ["k"])
    assert {r["k"]: r["action"] for r in once.collect()} == {1: "unchanged", 2: "update", 3: "keep", 4: "create"}
    again = upsert.diff(upsert.apply(once), new, ["k"])
    assert {r["action"]: r["n"] for r in upsert.counters(again).collect()} == {"unchanged": 3, "keep": 1}


def test_reasons_titles_and_keys(spark):
    rows = spark.createDataFrame([(1, "x", 5), (2, "", 5), (3, "x", 5), (4, "y", 500)], "i int, name string, n int")
    marked = upsert.with_reasons(rows, [(F.col("name") == "", "empty"), (F.col("n") > 100, "range")], ["name"], "i")
    assert [r["skip_reason"] for r in marked.orderBy("i").collect()] == [None, "empty", "duplicate", "range"]
    titles = spark.createDataFrame([("t",), ("t (2)",), ("t (4)",), ("other",)], "title string")
    assert upsert.free_title(titles, "t").first()["title"] == "t (3)" and upsert.free_title(titles, "new").first()["title"] == "new"
    latest = upsert.latest_wins(spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "k int, v int, t string"), ["k"], "v")
    assert [tuple(r) for r in latest.collect()] == [(1, 2, "b")]
    formats = spark.createDataFrame([(1, "en", False), (2, "en", False), (3, "fr", True), (4, "fr", True)], "id int, language string, is_default boolean")
    assert {r["id"] for r in upsert.default_formats(formats).filter("is_default").collect()} == {1, 4}


def test_progress(spark):
    rows = [("pending", 0, 0, 4, 40), ("translating", 1, 0, 3, 47), ("review", 3, 2, 4, 70), ("review", 0, 0, 0, 60), ("approved", 0, 0, 4, 100)]
    df = spark.createDataFrame(rows, "status string, translated int, approved int, total int, want int")
    assert df.filter(progress.translation_progress(*(F.col(c) for c in ("status", "translated", "approved", "total"))) != F.col("want")).count() == 0
    docs = spark.createDataFrame([(1,), (2,), (3,)], "document_id int")
    translations = spark.createDataFrame([(1, 10, "review", 0, 1, 4), (1, 11, "pending", 0, 0, 4), (2, 12, "archived", 0, 0, 4), (2, 13, "translating", 0, 0, 4)], "document_id int, id int, status string, translated int, approved int, total int")
    got = {r["document_id"]: (r["stage_index"], r["progress"]) for r in progress.document_progress(docs, progress.translation_rows(translations)).collect()}
    assert got == {1: (3, 53), 2: (3, 70), 3: (2, 40)}
    phrases = spark.createDataFrame([("a", 1, True), ("b", 1, False)], "phrase_id string, document_id int, translatable boolean")
    done = spark.createDataFrame([(10, "a", "x", "approved"), (10, "b", "y", "approved")], "dt_id int, phrase_id string, translation string, status string")
    counted = {r["id"]: (r["translated"], r["approved"], r["total"]) for r in progress.counts(translations.select("document_id", "id", "status"), phrases, done).collect()}
    assert counted[10] == (1, 1, 1) and counted[12] == (0, 0, 0)


def test_route(spark):
    rows = [(1, 1, "ayah", "quran", True, None, "v"), (1, 2, "ayah", "quran", True, None, "v"), (1, 3, "text", "plain", True, None, None), (1, 4, "ayah", "quran", True, None, None), (1, 5, "text", "citation", False, None, None)]
    df = spark.createDataFrame([(1, g, o, *r) for g, o, *r in rows], "document_id int, group_id int, group_order int, content_type string, kind string, translatable boolean, status string, verse string")
    counts = lambda d: {r["method"]: r["n"] for r in route.run_counters(d).collect()}
    assert counts(route.route(df, has_key=True)) == {"quran_extract": 2, "quran_fallback": 1, "text": 2, "skipped_untranslatable": 1}
    assert counts(route.route(df, has_key=False)) == {"text": 4, "skipped_untranslatable": 1}
    again = df.withColumn("status", F.when(F.col("group_order") == 1, "approved").when(F.col("translatable"), "suggested"))
    assert counts(route.route(again, has_key=True)) == {"skipped_approved": 1, "skipped_existing": 3, "skipped_untranslatable": 1}
    limited = route.route(df, has_key=True, limit=1).orderBy("group_order").collect()
    assert [r["method"] for r in limited] == ["quran_extract", None, None, None, "skipped_untranslatable"]
    terms = spark.createDataFrame([("p", 1), ("p", 2)], "phrase_id string, glossary_id int")
    glossary = spark.createDataFrame([(1, "إسلام", "Islam"), (2, "x", "")], "id int, ar string, en string")
    other = spark.createDataFrame([(1, "fr", "l'islam")], "glossary_id int, iso string, title string")
    assert [[tuple(t) for t in r["pairs"]] for r in route.term_pairs(terms, glossary, other, "en").collect()] == [[("إسلام", "Islam")]]
    assert route.term_pairs(terms, glossary, other, "fr").first()["pairs"][0]["title"] == "l'islam"


def test_context(spark):
    rows = spark.createDataFrame([(1, i, k) for i, k in enumerate("aabcc")], "g int, i int, k string")
    assert [r["run"] for r in context.runs(rows, ["g"], ["i"], F.col("k")).orderBy("i").collect()] == [1, 1, 2, 3, 3]
    recent = rows.select("i", context.recent_references(F.col("k"), ["g"], ["i"], 3, 2).alias("r"))
    assert [r["r"] for r in recent.orderBy("i").collect()] == [[], ["a"], ["a"], ["b", "a"], ["c", "b"]]
    picked = context.round_robin(rows, "k", ["i"], 4)
    assert [r["k"] for r in picked.collect()] == ["a", "b", "c", "a"]
    assert stats.whole_corpus(rows, "g", "i", 1, 5).first()["complete"]
    assert not stats.whole_corpus(rows.filter("i <> 2"), "g", "i", 1, 4).first()["complete"]
    told = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 3, "a"), (1, 4, "")], "g int, i int, m string")
    assert stats.messages(told, ["g"], "i", "m").first()["error_message"] == "a؛ b"


SEGMENTS = "doc_id long, para double, ord int, kind string, content string, source string, score double, note string, terms array<struct<arabic:string,english:string,kind:string,label:string,note:string,surface:string>>, level int, footnote boolean"


def test_payload(spark, tmp_path):
    term = [("صبر", "patience", "terms", "", "", "بالصبر")]
    rows = [(1, 1.0, 1, "title", "عنوان", "", None, "", [], 2, False), (1, 2.0, 1, "quran", "آية", "سورة الشرح — 5", 0.9876, "", [], 0, False), (1, 2.0, 2, "term", "بالصبر", "", None, "", term, 0, False), (1, 2.001, 1, "text", "[1] حاشية", "", None, "footnote", [], 0, True)]
    sheet = export.sheet_rows(spark.createDataFrame(rows, SEGMENTS))
    assert [(r["csv_id"], r["tag"], r["confidence"], r["reason_code"], r["content_type_id"]) for r in sheet.orderBy("para", "ord").collect()] == [
        ("10", "heading2", 1.0, "word_heading_style", 4), ("20", "p", 0.988, "index_match", 1), ("20_10", "p", 0.6, "glossary_entry", 4), ("30", "footnote", 0.4, "no_evidence", 5),
    ]
    phrases = export.phrases(sheet, spark.createDataFrame([(1, "C3")], "doc_id long, title string"))
    body = json.loads(export.payload(phrases).first()["payload"])
    assert body["document"] == {"title": "C3", "paragraphs": 3, "phrases": 4, "by_content_type": {"ayah": 1, "footnote": 1, "text": 2}, "by_kind": {"heading": 1, "plain": 1, "quran": 1, "term": 1}, "needs_review": 0}
    assert "terms" not in body["phrases"][0]["analysis"] and body["phrases"][2]["analysis"]["terms"][0]["category"] == "term"
    saved, analysis, links = export.saved(phrases, spark.createDataFrame([(9, "صبر")], "id int, ar string"))
    assert saved.count() == analysis.count() == 4 and links.count() == 1
    path = f"{tmp_path}/documents"
    export.save_documents(phrases, spark.createDataFrame([(9, "صبر")], "id int, ar string"), path, 1)
    with pytest.raises(export.DuplicateTitle):
        export.save_documents(phrases, spark.createDataFrame([(9, "صبر")], "id int, ar string"), path, 2)
    export.save_documents(phrases.limit(1), spark.createDataFrame([(9, "صبر")], "id int, ar string"), path, 2, replace=True)
    assert export.stored_documents(spark, path).count() == 1
    export.save_documents(phrases, spark.createDataFrame([(9, "صبر")], "id int, ar string"), path, 2, replace=True)  # run again
    assert [list(r["glossary_ids"]) for r in export.stored_documents(spark, path).orderBy("phrase_id").collect() if r["glossary_ids"]] == [[9]] and export.stored_documents(spark, path).count() == 4
    names = phrases.select(export.file_name(F.lit(' a/b: "c" '), F.lit("Fr"), F.lit("fr"), F.lit(7), "docx").alias("n"), export.book_tag(F.lit("fr"), F.lit(7), F.lit(True), F.lit("2026-01-02").cast("date")).alias("t")).first()
    assert tuple(names) == ("a b   c - Fr [fr7].docx", "fr7 - 02/01/2026")
    screen = export.screen_rows(spark.createDataFrame(rows, SEGMENTS)).orderBy("para", "ord").collect()
    assert [r["part"] for r in screen] == ["عنوان"] * 4 and [r["conf"] for r in screen] == ["100%", "99%", "60%", "40%"]


def test_book(spark):
    rows = [("k1", 1, 1, "heading1", "p", "text", True, "h"), ("k2", 2, 1, "p", "p", "text", True, "a [1] b [2]"), ("k3", 2, 2, "p", "p", "text", True, "c"), ("k4", 3, 1, "footnote", "footnote", "footnote", True, "[1] n"), ("k5", 4, 1, "p", "p", "ayah", True, "v"), ("k6", 5, 1, "p", "p", "text", False, "ref"), ("k7", 6, 1, "p", "naqhara", "text", True, "t"), ("k8", 7, 1, "p", "p", "text", True, "lost"), ("k9", 8, 1, "footnote", "footnote", "footnote", True, "[2] m"), ("k10", 9, 1, "footnote", "footnote", "footnote", True, "[3] x")]
    phrases = spark.createDataFrame([(1, *r) for r in rows], "document_id int, phrase_id string, group_id int, group_order int, tag string, text_type string, content_type string, translatable boolean, text string")
    translations = spark.createDataFrame([(f"k{i}", f" t{i} ") for i in (1, 2, 3, 4, 5, 7, 9, 10)] + [("k8", " ")], "phrase_id string, translation string")
    book = export.book_rows(phrases, translations)
    got = {r["id"]: r for r in book.collect()}
    assert len(got) == 9 and [r["phrase_id"] for r in export.missing(phrases, translations).collect()] == ["k8"]
    assert (got["k2"]["splitted"], got["k3"]["splitted"], got["k6"]["translation"], got["k1"]["type"], got["k7"]["type"], got["k5"]["sub_type"]) == (0, 1, "ref", "title", "naqhara", "aya")
    assert export.book_rows(phrases, translations, include_untranslatable=False).count() == 8
    hosts = {r["id"]: (r["host"], r["marker"]) for r in export.footnote_hosts(book).collect()}
    assert hosts == {"k4": ("k2", "[1]"), "k9": ("k2", "[2]"), "k10": (None, None)}
    assert export.runs(book).select("run").distinct().count() == 8


def test_options(spark):
    df = spark.sql("select map('a', '1', 'b', 'true') d, map('b', 'false') o, map('a', '3') l, map('z', '1', 'b', 'maybe') bad")
    assert df.select(export.preferences(F.col("d"), F.col("o"), F.col("l"))).first()[0] == {"a": "3", "b": "false"}
    got = df.select(export.invalid_options(F.col("bad"), F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"))).alias("x")).first()["x"]
    assert (got["unknown"], got["not_boolean"]) == (["z"], ["b"])
    rows = spark.createDataFrame([("Ab", 1), ("cd", 2), ("cd", 2)], "t string, n int")
    assert export.search(rows, "aB", ["t", "n"]).count() == 1
    assert {(r["facet"], r["value"]): r["n"] for r in export.facets(rows, ["t", "n"]).collect()}[("t", "cd")] == 2


W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx(body, footnotes=""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')
        if footnotes:
            z.writestr("word/footnotes.xml", f'<w:footnotes xmlns:w="{W}">{footnotes}</w:footnotes>')
    return out.getvalue()


def para(text, style="", bold=False):
    return f'<w:p>{f"<w:pPr><w:pStyle w:val=\"{style}\"/></w:pPr>" if style else ""}<w:r>{"<w:rPr><w:b/></w:rPr>" if bold else ""}{text}</w:r></w:p>'


def t(text):
    return f"<w:t>{text}</w:t>"


def test_docx(spark, tmp_path):
    cover = f"<w:tbl><w:tr><w:tc>{para(t('الكتاب'))}</w:tc><w:tc>{para(t('المؤلف'))}</w:tc></w:tr></w:tbl>"
    body = cover + para(t("صفحة")) + para(t("1. مقدمة"), "Heading1") + para(t("نص الفقرة") + '<w:footnoteReference w:id="2"/>' + t(" تتمة")) + para(t("فهرس"), "Heading2") + para(t("بند"), "toc 1") + para('<w:sym w:font="F1" w:char="F022"/><w:sym w:font="F1" w:char="F021"/>')
    notes = f'<w:footnote w:id="2"><w:p><w:r>{t("() حاشية")}</w:r></w:p></w:footnote>'
    (tmp_path / "a.docx").write_bytes(docx(body, notes))
    (tmp_path / "b.docx").write_bytes(bytes.fromhex(files.OLE2) + b"x")
    letters = {(r["font"], r["char"]): r["letter"] for r in files.glyphs(spark.createDataFrame([("F1", "21", "22", "ب")], "font string, first string, last string, letter string")).collect()}
    got = files.read_docx(spark, str(tmp_path), letters).orderBy("para").collect()
    assert [(r["text"], r["heading"], r["level"], r["cover"]) for r in got] == [("الكتاب", True, 1, True), ("المؤلف", False, 0, True), ("مقدمة", True, 1, False), ("نص الفقرة تتمة", False, 0, False), ("بب", False, 0, False)]
    assert [tuple(f) for f in got[3]["footnotes"]] == [("نصالفقرة", "حاشية")] and got[4]["verses"] == ["بب"]
    kinds = {r["path"][-6:]: r["d"] for r in files.files(spark, str(tmp_path)).select("path", files.diagnosis(F.col("content")).alias("d")).collect()}
    assert kinds == {"a.docx": "package", "b.docx": "legacy"}
    plain = docx(para(t("عنوان قصير"), bold=True) + para(t("نص")))
    assert [(p["text"], p["heading"]) for p in files.docx_paragraphs(plain)] == [("عنوان قصير", True), ("نص", False)]


def xlsx(rows):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        cells = "".join("<row>" + "".join(f'<c r="{chr(65 + j)}{i}" t="inlineStr"><is><t>{v}</t></is></c>' for j, v in enumerate(r) if v is not None) + "</row>" for i, r in enumerate(rows, 1))
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{cells}</sheetData></worksheet>')
    return out.getvalue()


def test_sheets_and_text_files(spark, tmp_path):
    (tmp_path / "quran_fr.xlsx").write_bytes(xlsx([[" Sura ", "Aya", "translation"], ["1", "2", " Louange "], [None, None, None], ["x", None, "z"]]))
    got = files.read_sheet(spark, str(tmp_path), ["sura", "translation"]).withColumn("n", files.to_int(F.col("sura"))).collect()
    assert [(r["n"], r["translation"]) for r in got] == [(1, "Louange"), (None, "z")]
    assert [r["key"] for r in files.keyed_files(spark, str(tmp_path), r"^quran_([A-Za-z-]+)\.xlsx$").collect()] == ["fr"]
    with pytest.raises(Exception, match="lacks"):
        files.read_sheet(spark, str(tmp_path), ["nothing"]).collect()
    (tmp_path / "t.csv").write_text('id,title,x\n1,"a\nb",-\n', encoding="utf-8")
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "t.csv"), ["id", "title", "x"]).collect()] == [("1", "a\nb", "")]
    (tmp_path / "v.json").write_text('[{"surah": "s", "ayah": 1}]')
    assert files.read_json(spark, str(tmp_path / "v.json"), "surah string, ayah int").count() == 1
    counted = files.promised_counts(spark.createDataFrame([(1,), (1,)], "g int"), spark.createDataFrame([(1, 2), (2, 3)], "g int, n long"), "g")
    assert [tuple(r) for r in counted.collect()] == [(2, 3, 0)]


def test_sweep_can_be_repeated(spark, tmp_path):
    source, target, mark = (str(tmp_path / x) for x in ("in", "out", "ck"))
    spark.createDataFrame([(1, "pending"), (2, "approved")], "id int, status string").write.parquet(source)
    for _ in range(2):
        sweep.sweep(spark, source, "id int, status string", target, mark, lambda df: df)
    assert [r["id"] for r in spark.read.parquet(target).collect()] == [1]


def test_pass_statistics_and_dates(spark):
    from glosstream.functions import dates, text
    from glosstream.operators import stats

    rows, seen = stats.observed(spark.range(10), "pass", {"even": F.col("id") % 2 == 0, "big": F.col("id") > 6})
    assert rows.count() == 10 and seen.get == {"rows": 10, "even": 5, "big": 3}
    df = spark.sql("SELECT timestamp'2024-02-03 04:05:06' AS a, timestamp'2024-02-03 04:06:00' AS b, 'بِسْمِ الله' AS t, '' AS e")
    got = df.select(dates.local_day(F.col("a")).alias("day"), dates.iso(F.col("a")).alias("iso"), dates.age_seconds(F.col("a"), F.col("b")).alias("age"), text.diacritic_density(F.col("t")).alias("d"), text.diacritic_density(F.col("e")).alias("z")).first()
    assert got["day"] == "03/02/2024" and got["iso"].startswith("2024-02-03T04:05:06") and got["age"] == 54 and abs(got["d"] - 3 / 7) < 1e-9 and got["z"] == 0
