"""The reading side: screens, sheets and what is loaded back."""

from pyspark.sql import functions as F

from glosstream.operators import audit, export, match, route


def test_screen_progress(spark):
    phrases = spark.createDataFrame([(1, "a", 1, 1, "quran", True), (1, "b", 1, 2, "quran", True), (1, "c", 1, 3, "plain", True), (1, "d", 1, 4, "plain", True), (1, "e", 1, 5, None, False)], "document_id int, phrase_id string, group_id int, group_order int, kind string, translatable boolean")
    translations = spark.createDataFrame([("a", "v"), ("b", "w"), ("c", "The blessing of Islam."), ("d", "")], "phrase_id string, translation string")
    titles = spark.createDataFrame([("c", ["islam"])], "phrase_id string, titles array<string>")
    got = {r["place"]: r["source"] for r in route.screen_progress(phrases, translations, titles, has_key=True).collect()}
    assert got == {0: "locked", 1: "locked", 2: "glossary"}
    assert {r["source"] for r in route.screen_progress(phrases, translations, titles.filter("false"), has_key=False).collect()} == {None}
    assert tuple(route.screen_totals(phrases, translations).first()) == (1, 3, 4)


def test_prune(spark):
    df = spark.sql("select array(struct('x' as ar, 'Islam' as en)) t, 'A blessing.' a, 'The blessing of ISLAM.' b, '' c")
    got = df.select(*(F.size(route.prune_terms(F.col("t"), F.col(c))).alias(c) for c in "abc")).first()
    assert tuple(got) == (0, 1, 1)


def test_verses_and_languages(spark):
    matches = spark.createDataFrame([("p", 1, 2), ("q", 1, 3)], "phrase_id string, surah_no int, ayah_no int")
    verses = spark.createDataFrame([(7, 1, 2), (8, 1, 3)], "id int, surah_no int, ayah_no int")
    texts = spark.createDataFrame([(7, 1, "t"), (8, 2, "u")], "ayah_id int, key_id int, text string")
    assert [tuple(r) for r in route.approved_verses(matches, verses, texts, 1).collect()] == [("p", "t")]
    languages = spark.createDataFrame([(1, "en", "English"), (2, "fr", "French"), (3, "xx", "EN")], "id int, iso_code string, name string")
    assert [r["id"] for r in route.languages_with_key(languages, spark.createDataFrame([(2,), (1,)], "language_id int")).collect()] == [1, 2]
    assert route.language_of(languages, "EN").first()["id"] == 1 and route.language_of(languages, "French").first()["id"] == 2 and route.language_of(languages, "zz").count() == 0


def test_jobs(spark):
    jobs = spark.createDataFrame([(i,) for i in range(5)], "job_id int")
    groups = spark.createDataFrame([(1, "done"), (1, "done"), (2, "done"), (2, "failed"), (3, "failed"), (4, "failed"), (4, "pending")], "job_id int, status string")
    assert {r["job_id"]: r["status"] for r in audit.job_statuses(jobs, groups).collect()} == {0: "done", 1: "done", 2: "partial", 3: "failed", 4: "running"}
    rows = spark.createDataFrame([(9, 2, "s", "t"), (8, 1, "a", "b")], "id int, seq int, source_text string, target_text string")
    found = audit.export_findings(rows, spark.createDataFrame([(9, 1, "X"), (8, 2, "Y"), (8, 1, "Z")], "row_id int, seq int, code string"))
    assert [r["code"] for r in found.collect()] == ["Z", "Y", "X"]


def test_segments_come_back(spark):
    phrases = spark.createDataFrame([("p", 1, 1, 1, "x")], "phrase_id string, doc_id long, para_no int, ord int, content string")
    analysis = spark.createDataFrame([("p", "heading", "word_heading_style", 100, "")], "phrase_id string, kind string, reason_code string, confidence int, reference string")
    links, glossary = spark.createDataFrame([("p", 2), ("p", 1)], "phrase_id string, glossary_id int"), spark.createDataFrame([(1, "a", "A"), (2, "b", "B")], "id int, ar string, en string")
    got = export.stored_segments(phrases, analysis, links, glossary).first()
    assert (got["kind"], got["confidence"], [t["ar"] for t in got["terms"]]) == ("title", 1.0, ["a", "b"])


def test_translation_sheet(spark):
    phrases = spark.createDataFrame([(1, "p", 1, 1, "heading1", "text", "h", True), (1, "q", 1, 2, "p", "ayah", "v", False)], "document_id int, phrase_id string, group_id int, group_order int, tag string, content_type string, text string, translatable boolean")
    got = export.translation_sheet(phrases, spark.createDataFrame([("q", " t ")], "phrase_id string, translation string")).orderBy("n").collect()
    assert [(r["kind"], r["translation"], r["missing"]) for r in got] == [("heading", "", True), ("ayah", "t", False)]


def test_review_candidates(spark):
    make = lambda rows: spark.createDataFrame(rows, "ref_id long, text string")
    queries = spark.createDataFrame([(1, "a b c d"), (2, "x y z"), (3, "no such words")], "key int, text string")
    got = match.review_candidates(queries, {"Q": make([(1, "a b c d e"), (2, "b c d")]), "H": make([(1, "x y z"), (2, "a b c q")])}, 2).collect()
    by = {k: sorted((r["kind"], r["ref_id"]) for r in got if r["key"] == k) for k in (1, 2, 3)}
    assert by == {1: [("Q", 1), ("Q", 2)], 2: [("H", 1)], 3: []}
