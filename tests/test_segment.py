from hypothesis import given, settings
from hypothesis import strategies as st

from glosstream.operators import segment as S

RAW = "الإخلاص في العمل\n\nالحمد لله رب العالمين، والصلاة والسلام على رسول الله.\nقال الله تعالى: ﴿فإن مع العسر يسرا﴾.\nفعليكم بالصبر والإخلاص في الأعمال كلها، والله الموفق."


def test_paragraphs(spark):
    df = spark.createDataFrame([(1, RAW), (2, "# 1. Head #\n**Bold line**\n> quoted\n---\n**Not a heading because it ends.**\n\n  "), (3, None), (4, "")], "doc_id long, text string")
    got = S.paragraphs(df).orderBy("doc_id", "para").collect()
    assert [r["para"] for r in got if r["doc_id"] == 1] == [1, 2, 3, 4]
    two = [(r["text"], r["heading"], r["level"], r["quoted"]) for r in got if r["doc_id"] == 2]
    assert two == [("Head", True, 1, False), ("Bold line", True, 2, False), ("quoted", False, 0, True), ("Not a heading because it ends.", False, 0, False)]
    assert {r["doc_id"] for r in got} == {1, 2}


def test_rules():
    assert S.split_by_rules("قال الله تعالى: ﴿فإن مع العسر يسرا﴾.") == ["قال الله تعالى:", "﴿فإن مع العسر يسرا﴾."]
    assert S.split_by_rules("One. Two (a. b). Three...") == ["One.", "Two (a. b).", "Three..."]
    assert S.split_by_rules("A. Smith wrote this here [Book: 2].") == ["A. Smith wrote this here", "[Book: 2]."]
    assert S.after_closed_quotes(["«إنما الأعمال بالنيات وإنما». فالصبر عبادة قلبية."]) == ["«إنما الأعمال بالنيات وإنما».", "فالصبر عبادة قلبية."]
    for text in ("«إنما الأعمال بالنيات» رواه البخاري.", "وقال: «الدين النصيحة»."):
        assert S.after_closed_quotes([text]) == [text]
    assert S.leading_commas_back(["﴿آية﴾", "، وقال النبي ﷺ:"]) == ["﴿آية﴾،", "وقال النبي ﷺ:"]


@settings(max_examples=300, deadline=None)
@given(st.text("ab .،:!«»()﴿﴾\"[]", max_size=40))
def test_a_split_never_loses_a_character(text):
    units = S.split_units(text)
    assert not text.strip() or S.reconstructs(text, units)


def test_units_and_invariant(spark):
    df = spark.createDataFrame([(1, RAW), (2, "Ab cd. Ef gh! Ij")], "doc_id long, text string")
    paras = S.paragraphs(df)
    units = S.units(paras)
    assert [r["unit"] for r in units.filter("doc_id = 2").orderBy("ord").collect()] == ["Ab cd.", "Ef gh!", "Ij"]
    assert S.reconstruction_failures(paras, units).count() == 0


def test_trailing_leadins(spark):
    rows = [
        (1, 1.0, 1, "term", "الحمد لله رب العالمين، والصلاة والسلام على أشرف الأنبياء والمرسلين. قال الله تعالى:", ""),
        (1, 2.0, 1, "text", "وختام القول: أن نجعل نياتنا خالصة لله.", "n"),
        (1, 3.0, 1, "text", "قال تعالى:", ""),
    ]
    df = spark.createDataFrame(rows, "doc_id long, para double, ord int, kind string, content string, note string")
    got = [(r["para"], r["ord"], r["kind"], r["content"]) for r in S.split_trailing_leadins(df).orderBy("para", "ord").collect()]
    assert [g[2] for g in got] == ["term", "attribution", "text", "attribution"]
    assert got[1][3] == "قال الله تعالى:" and got[2][3] == rows[1][4]


def test_empty_brackets(spark):
    texts = ["{ لا تقبل صلاة بغير طهور } ().", "()،", "() الآية.", "قال (رحمه الله) ذلك."]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, content string")
    assert [r["content"] for r in S.drop_empty_brackets(df).orderBy("i").collect()] == ["{ لا تقبل صلاة بغير طهور }.", "الآية.", "قال (رحمه الله) ذلك."]


def test_cuts_merges_and_spans(spark):
    assert S.apply_cuts("one two three", ["two", "none", "three"]) == ["one", "two", "three"]
    assert S.apply_merges(["a", "b", "c"], [1]) == ["a", "b c"]
    df = spark.createDataFrame([(["text", "quran", "quran", "text", "hadith"],), ([],)], "t array<string>")
    got = [[tuple(x) for x in r[0]] for r in df.select(S.tag_spans(df["t"])).collect()]
    assert got == [[(1, 3, "quran"), (4, 5, "hadith")], []]
