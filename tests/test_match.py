"""Matching against a reference corpus, anchors, speakers."""

import pytest
from pyspark.sql import functions as F

from glosstream.functions.text import matching_forms
from glosstream.operators import match as M
from glosstream.operators import speaker as P

VERSES = [
    ("الفاتحة", 1, 1, "بسم الله الرحمن الرحيم"), ("الفاتحة", 1, 2, "الحمد لله رب العالمين"), ("الفاتحة", 1, 3, "الرحمن الرحيم"), ("الفاتحة", 1, 4, "مالك يوم الدين"), ("الفاتحة", 1, 5, "إياك نعبد وإياك نستعين"),
    ("الإخلاص", 112, 1, "قل هو الله أحد"), ("الإخلاص", 112, 2, "الله الصمد"), ("الإخلاص", 112, 3, "لم يلد ولم يولد"), ("الإخلاص", 112, 4, "ولم يكن له كفوا أحد"),
    ("الشرح", 94, 5, "فإن مع العسر يسرا"), ("الشرح", 94, 6, "إن مع العسر يسرا"), ("الرحمن", 55, 13, "فبأي آلاء ربكما تكذبان"), ("الرحمن", 55, 15, "وخلق الجان من مارج من نار"), ("الرحمن", 55, 16, "فبأي آلاء ربكما تكذبان"),
]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(i, *v) for i, v in enumerate(VERSES)], "ref_id long, surah string, surah_no int, ayah int, text string")


def test_matches(spark, table):
    texts = ["فإن مع العسر يسرا", "مع العسر", "الصمد", "قل هو الله", "لا شيء هنا", "إياك نعبد وإياك نستعين اهدنا", "ٱلرَّحۡمَٰنِ ٱلرَّحِيمِ", ""]
    for short in (False, True):
        df = spark.createDataFrame([(i, t, short, "") for i, t in enumerate(texts)], "key int, text string, short boolean, prefer string")
        got = {r["key"]: (r["ref_id"], round(r["score"], 2)) for r in M.match_texts(df, table).collect()}
        assert got == {0: (9, 1.0), 1: (9, 1.0), 3: (5, 1.0), 5: (4, 0.8), 6: (0, 1.0)} | ({2: (6, 1.0)} if short else {})


def test_the_preferred_group_wins_within_the_margin(spark, table):
    df = spark.createDataFrame([(0, "الرحمن الرحيم", False, "الفاتحة"), (1, "مع العسر يسرا", False, "")], "key int, text string, short boolean, prefer string")
    assert {r["key"]: r["ref_id"] for r in M.match_texts(df, table).collect()} == {0: 0, 1: 9}
    named = spark.createDataFrame([(1, "ا", "x y z"), (2, "ب", "x y z")], "ref_id long, surah string, text string")
    df = spark.createDataFrame([(0, "x y z", False, "ب"), (1, "x y z", False, "")], "key int, text string, short boolean, prefer string")
    assert {r["key"]: r["ref_id"] for r in M.match_texts(df, named).collect()} == {0: 2, 1: 1}


def test_speakers(spark):
    intros = ["فقال عمر رضي الله عنه:", "عن أبي هريرة رضي الله عنه قال: سمعت رسول الله صلى الله عليه وسلم يقول:", "قال في مسجد النبي بعض الناس:", "قال الإمام أحمد رحمه الله:", "وفي مسجد النبي قال عمر:", "قال له النبي ﷺ:", "كلام بلا فعل:", "", None, "انتهى. قالت عائشة: «"]
    columns = spark.createDataFrame([(i, t) for i, t in enumerate(intros)], "n int, t string").select("n", P.speaker(F.col("t")).alias("who")).orderBy("n").collect()
    assert [r["who"] for r in columns] == ["companion", "prophet", None, "scholar", "companion", "prophet", None, None, None, "companion"]
    df = spark.createDataFrame([(1, 1.0, 1, "text", "فقال عمر رضي الله عنه:", "", False), (1, 1.0, 2, "hadith", "لا شيء", "m", False), (1, 2.0, 1, "hadith", "x", "", False)], "doc_id long, para double, ord int, kind string, content string, note string, reviewed boolean")
    got = P.reattribute(df).orderBy("para", "ord").collect()
    assert [r["kind"] for r in got] == ["text", "athar", "hadith"] and got[1]["reviewed"]


def test_find_verses(spark):
    verses = spark.createDataFrame([(b, n, a, t) for a, b, n, t in VERSES], "surah_no int, ayah_no int, surah_name string, text_uthmani string")
    verses = verses.withColumns(matching_forms(F.col("text_uthmani"), F.col("text_uthmani")))
    phrases = [
        ("p1", "الحمد لله رب العالمين", "سورة الفاتحة — 2"), ("p2", "يَوْمِ الدِّينِ", ""), ("p3", "هذا ليس آية على الإطلاق", ""), ("p4", "الله الصمد", "سورة الفاتحة — 1"), ("p5", "حمد لله رب العا", ""),
        ("p6", "صم", ""), ("p7", "فبأي آلاء ربكما تكذبن", ""), ("p8", "...", ""), ("p9", None, None),
    ]
    asked = spark.createDataFrame(phrases, "phrase_id string, text string, reference string")
    got = {r["phrase_id"]: (r["surah_no"], r["ayah_no"], r["method"], r["exact_full"]) for r in M.find_verses(asked, verses).collect()}
    assert got == {
        "p1": (1, 2, "reference", True), "p2": (1, 4, "clean", False), "p4": (112, 2, "clean", True), "p5": (1, 2, "clean", False), "p6": (112, 2, "clean", False), "p7": (55, 13, "fuzzy", False),
    }
    near = M.nearby_verses(spark.createDataFrame([("الإخلاص", 3)], "surah string, ayah int"), verses.select(F.col("surah_name").alias("surah"), F.col("ayah_no").alias("ayah"), F.col("text_uthmani").alias("text")))
    assert sorted(r["near_ayah"] for r in near.collect()) == [2, 3, 4]
