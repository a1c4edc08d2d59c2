import json

import pytest
from pyspark.sql import functions as F

from glosstream.config import Config
from glosstream.operators import audit, parse, stats

WORDS = "فيه كلمات كثيرة للتجربة والفحص والمراجعة"


def pairs(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows, 1)], "seq int, source string, target string")


def rules(spark, *rows, **how):
    return audit.apply_rules(pairs(spark, *rows), **how).orderBy("seq").collect()


def test_rules(spark):
    got = rules(spark, ("نص", ""), ("نص", " -.- "), ("هذا نص عربي", "هذا نص عربي."), ("نص", "Text with كلمة inside"), ("نص", "Text with ﷺ and ۝ only"), ("نص", "Text (broken here"), ("نص (", "Text (broken here"), (None, None))
    assert [[f["code"] for f in r["findings"]] for r in got] == [["FRM-EMP"], ["FRM-EMP"], ["FRM-CPY"], ["FRM-ARB"], [], ["FRM-BRK"], [], ["FRM-EMP"]]
    assert [r["skip"] for r in got] == ["empty", "empty", "copy", None, None, None, None, "empty"]
    assert got[3]["findings"][0]["location"] == "كلمة" and got[5]["findings"][0]["confidence"] == 90
    assert rules(spark, ("نص", "Text with كلمة inside"), arabic_script=True)[0]["findings"] == []


def test_duplicate_targets_are_hints(spark):
    got = rules(spark, ("نص أول مختلف تماما عن غيره", "Same translation here"), ("كلام آخر لا يشبه ذاك البتة", "same  translation here"), ("نص أول مختلف تماما عن غيره!", "Another"), ("قصير", "Same pair"), ("آخر", "Same pair"))
    assert [len(r["hints"]) for r in got] == [1, 1, 0, 0, 0] and "كلام آخر" in got[0]["hints"][0]
    assert all(not r["findings"] for r in got)


def test_length_hints(spark):
    rows = [(f"هذا نص عربي رقم {i} {WORDS}", "x" * 50) for i in range(11)] + [(f"هذا نص عربي رقم 99 {WORDS}", "xx"), (f"هذا نص عربي رقم 98 {WORDS}", "x " * 150)]
    got = rules(spark, *rows)
    assert [bool([h for h in r["hints"] if "shorter" in h or "longer" in h]) for r in got[-3:]] == [False, True, True]
    assert audit.median_ratio(pairs(spark, *rows[:9])).first()["median_ratio"] is None


def fixture(spark):
    phrases = [("d", f"p{i}", i, 1, f"هذا نص عربي رقم {i} {WORDS}", True, "naqhara" if i == 11 else "p") for i in range(1, 13)] + [("d", "p13", 13, 1, "مرجع", False, "p")]
    phrases = spark.createDataFrame([(1, *p[1:]) for p in phrases], "document_id long, phrase_id string, group_id int, group_order int, text string, translatable boolean, text_type string")
    targets = {i: f"This is an English text number {i} with many words for the test" for i in range(1, 13)}
    targets.pop(2)
    targets[4] = f"هذا نص عربي رقم 4 {WORDS}"
    targets[7] = "This is an English text number 7 with the word كلمة inside it"
    translations = spark.createDataFrame([(f"p{i}", t) for i, t in targets.items()], "phrase_id string, translation string")
    analysis = spark.createDataFrame([("p1", "quran", "index_match"), ("p3", "quran", "unmatched_quran")], "phrase_id string, kind string, reason_code string")
    return phrases, analysis, translations


def test_job(spark):
    rows = audit.audit_rows(*fixture(spark), has_key=False)
    assert rows.count() == 12 and rows.filter("row_type = 'transliteration'").first()["seq"] == 11
    assert audit.audit_rows(*fixture(spark), has_key=True).count() == 11
    ruled = audit.apply_rules(rows)
    grouped = audit.groups(ruled, 5)
    by = {r["group_key"]: sorted(r["s"]) for r in grouped.groupBy("group_key").agg(F.collect_list("seq").alias("s")).collect()}
    assert by == {"j1-g00000": [1, 3, 5, 6, 7], "j1-g00001": [8, 9, 10, 11, 12]}


def test_run_with_a_fake_model(spark):
    ruled = audit.apply_rules(audit.audit_rows(*fixture(spark), has_key=False))

    def reply(rows):
        bad = {"code": "SEM-WRG", "severity": "كبير", "location": "x"}
        return "```json\n" + json.dumps([{"id": r["seq"], "summary": "s", "errors": [bad, bad] if r["seq"] % 3 == 0 else []} for r in rows]) + "\n```"

    got = audit.run_verified(ruled, reply, 5).collect()
    assert {r["status"] for r in got} == {"done"} and {r["attempts"] for r in got} == {1}
    assert sorted(r["seq"] for r in got if json.loads(r["errors"])) == [3, 6, 9, 12]
    failed = audit.run_verified(ruled, lambda rows: "[]", 5, 2).collect()
    assert {(r["status"], r["attempts"]) for r in failed} == {("failed", 2)}


def test_a_job_from_its_rows_to_its_end(spark, tmp_path):
    job = audit.create_job(audit.audit_rows(*fixture(spark), has_key=False), types=TYPES, config=Config(group_size=5))
    start = {r["seq"]: r for r in job.collect()}
    assert {s: start[s]["status"] for s in (2, 4)} == {2: "skipped", 4: "skipped"} and start[2]["summary"] == "empty" and start[2]["error_count"] == 1 and start[2]["group_key"] is None
    assert start[1]["status"] == "pending" and start[1]["verdict"] is None and [f["type_name"] for f in start[7]["errors"]] == ["غير مصنَّف (FRM-ARB)"]
    calls = spark.sparkContext.accumulator(0)

    def reply(rows):
        calls.add(1)
        if any(r["seq"] == 12 for r in rows):
            return "no answer"
        bad = {"code": "SEM-WRG", "severity": "حرج", "location": "x"}
        return json.dumps([{"id": r["seq"], "summary": "s", "errors": [bad] if r["seq"] in (3, 7) else []} for r in rows])

    audit.run_job(job, reply, TYPES, Config(group_size=5, max_attempts=2)).write.parquet(f"{tmp_path}/job")
    ran = spark.read.parquet(f"{tmp_path}/job")
    assert calls.value == 3  # one group at once, the other twice
    rows = {r["seq"]: r for r in ran.collect()}
    assert [f["type_code"] for f in rows[7]["errors"]] == ["OTHER", "SEM-WRG"] and [f["source"] for f in rows[7]["errors"]] == ["rule", "model"]
    assert (rows[3]["verdict"], rows[3]["max_severity"], rows[3]["needs_review"], rows[3]["error_count"]) == ("rejected", "حرج", True, 1)
    assert (rows[1]["status"], rows[1]["verdict"], rows[1]["summary"]) == ("done", "accepted", "s") and rows[12]["status"] == "failed" and rows[12]["verdict"] is None
    end = audit.finalize(ran).first()
    assert (end["status"], end["findings"], end["rows_done"], end["rows_failed"], end["rows_skipped"], end["groups_done"], end["groups_failed"]) == ("partial", 5, 5, 5, 2, 1, 1)
    assert sorted((r["row_seq"], r["seq"]) for r in audit.findings_of(ran).collect()) == [(2, 1), (3, 1), (4, 1), (7, 1), (7, 2)]
    again = {r["seq"]: r for r in audit.run_job(ran, reply, TYPES).collect()}
    assert calls.value == 3 and {s: r["status"] for s, r in again.items()} == {s: r["status"] for s, r in rows.items()}
    with pytest.raises(ValueError):
        audit.create_job(audit.audit_rows(*fixture(spark), has_key=False).limit(0))


def test_retries(spark):
    calls = spark.createDataFrame([("a", 1, False), ("a", 2, True), ("b", 1, False), ("b", 2, False), ("c", 1, False)], "group_key string, attempt int, ok boolean")
    assert {r["group_key"]: (r["attempts"], r["status"]) for r in audit.retries(calls, 2).collect()} == {"a": (2, "done"), "b": (2, "failed"), "c": (1, "pending")}


def test_model_findings_are_numbered_behind_rules(spark):
    kind = "row_id int, seq int, code string"
    got = audit.merge_findings(spark.createDataFrame([(1, 1, "R")], kind), spark.createDataFrame([(1, 5, "M"), (1, 9, "N"), (2, 3, "O")], kind))
    assert sorted(map(tuple, got.collect())) == [(1, 1, "R"), (1, 2, "M"), (1, 3, "N"), (2, 1, "O")]


def test_statistics(spark):
    rows = spark.createDataFrame([("done", 1, "a b c", True), ("skipped", 0, "a b", False), ("failed", 0, "z", False), ("pending", 0, "z", False)], "status string, error_count int, source string, needs_review boolean")
    findings = spark.createDataFrame([(True,), (False,)], "sensitive boolean")
    got = audit.statistics(rows, findings).first().asDict()
    assert (got["total"], got["pending"], got["error_rows_pct"], got["errors_per_100_rows"], got["errors_per_1000_words"], got["sensitive"]) == (4, 1, 50.0, 100.0, 400.0, 1)
    assert stats.percent(F.lit(3), F.lit(8)) is not None


TYPES = {"SEM-WRG": {"code": "SEM-WRG", "category": "SEM", "category_name": "c", "name": "n", "severity": "كبير", "sensitive": False, "detection": "استدلالي", "action": "fix"}}


def test_parsing(spark):
    texts = ['noise [1, [{"id": 1}]] tail', '{"items": [{"id": "2"}]}', '```json\n[{"id": 3}]\n```', "none [", "[]", None, 'see [4] and [{"id": 4, "summary": "a [b] c"}]']
    df = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    got = [r["i"] for r in df.select("n", parse.items_of(F.col("text")).alias("i")).orderBy("n").collect()]
    assert [x and [y["id"] for y in x] for x in got] == [["1"], ["2"], ["3"], None, None, None, ["4"]] and got[6][0]["summary"] == "a [b] c"
    assert [parse.answered(t) for t in texts] == [set(), {2}, {3}, set(), set(), set(), set()]
    raw = spark.createDataFrame([({"code": "sem_wrg", "severity": "Critical", "sharia_sensitive": "نعم"},), ({"code": "ZZZ", "confidence": "0.9"},), ({"code": None, "severity": "low"},)], f"raw {parse.FINDING_IN}")
    f, other, bare = (r["f"] for r in raw.select(parse.finding(F.col("raw"), TYPES).alias("f")).collect())
    assert (f["type_code"], f["severity"], f["sharia_sensitive"], f["needs_human_review"], f["required_action"], f["type_name"], f["category"]) == ("SEM-WRG", "حرج", True, True, "fix", "n", "c")
    assert (other["type_code"], other["type_name"].endswith("(ZZZ)"), other["confidence"], other["detection"]) == ("OTHER", True, 90, "استدلالي")
    assert (bare["type_name"], bare["severity"], bare["confidence"]) == ("غير مصنَّف", "بسيط", 70)


def test_groups_are_complete(spark):
    reply = json.dumps([{"id": 1, "findings": [{"code": "A", "location": str(i)} for i in range(9)]}, {"id": "2", "errors": None}, {"id": "x"}, {"id": 1, "errors": [{"code": "A"}, {"code": "A"}]}, {"id": 77}, {"id": 5, "errors": [{"code": "B", "location": str(i)} for i in range(9)]}])
    items = parse.validated(spark.createDataFrame([("g", reply)], "group_key string, text string"))
    got = {r["id"]: r["errors"] for r in items.collect()}
    assert len(got[1]) == 1 and got[2] == [] and 77 in got and [f["location"] for f in got[5]] == list("012345")
    expected = spark.createDataFrame([("g", 1), ("g", 2), ("g", 3)], "group_key string, id long")
    assert [r["id"] for r in parse.missing_answers(items, expected).collect()] == [3]
    assert parse.answered(reply) == {1, 2, 77, 5}


def test_replies(spark):
    item = {"response": {"candidates": [{"content": {"parts": [{"text": "thought", "thought": True}, {"text": "[]"}]}}], "usageMetadata": {"promptTokenCount": 5, "candidatesTokenCount": 2}}}
    replies = [item, {"response": {"promptFeedback": {"blockReason": "SAFETY"}}}, {"error": {"message": "no quota"}}, {"error": "down"}, {"response": {"candidates": [{"content": {"parts": []}}]}}]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(replies)], "n int, reply string").select("n", parse.reply_parts(F.col("reply")).alias("r")).orderBy("n")
    got = [tuple(r["r"]) for r in df.collect()]
    assert got[0] == ("[]", None, 5, 2) and "SAFETY" in got[1][1] and got[2][1] == "no quota" and got[3][1] == "down" and got[4][1] == "empty reply"
    delays = spark.createDataFrame([('{"retryDelay": "7.5s"}', 1), ("", 3), (None, 2)], "body string, attempt int")
    assert [r[0] for r in delays.select(parse.retry_delay(F.col("body"), F.col("attempt"))).collect()] == [7.5, 8.0, 4.0]


def test_confidence_column(spark):
    df = spark.createDataFrame([("0.9",), ("1",), ("85%",), (None,), ("x",), ("400",)], "v string")
    assert [r[0] for r in df.select(parse.confidence_column(F.col("v"))).collect()] == [90, 100, 85, 70, 70, 100]


def test_defaults():
    assert Config().group_size == 20 and Config().max_attempts == 3
