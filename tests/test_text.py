"""Text functions on Arabic literals; the Column and plain versions must agree."""

import pytest
from pyspark.sql import functions as F

from glosstream.functions import plain
from glosstream.functions import text as T
from glosstream.functions.identity import hashed_feature, phrase_id

SAMPLES = ["بِسْمِ اللَّهِ الرَّحْمَٰنِ الرَّحِيمِ", "أإآٱىؤئة", "الحمدُ لله، ربِّ العالمين.", "", "  a  b ", "ءَامَنُوا۟ ۖ", "ياايها الناس"]


@pytest.fixture(scope="module")
def values(spark):
    def run(column, *rows):
        schema = ", ".join(f"c{i} string" for i in range(len(rows[0])))
        df = spark.createDataFrame(list(rows), schema)
        return [r[0] for r in df.select(column(*map(F.col, df.columns)).alias("v")).collect()]

    return run


@pytest.mark.parametrize("name", ["normalize", "lexical", "light", "expand_dagger", "split_vocative"])
def test_column_and_plain_agree(values, name):
    assert values(getattr(T, name), *[(s,) for s in SAMPLES]) == [getattr(plain, name)(s) for s in SAMPLES]


def test_affix_forms_agree(values):
    words = ["بالصلاة", "والتوكل", "كتابهم", "رحمتها", "لله", "فبالحق", "دعواه", "ال"]
    assert values(T.affix_forms, *[(w,) for w in words]) == [plain.affix_forms(w) for w in words]
    assert plain.affix_forms("بصلاة")[1] == "صلاة"
    assert "رحمة" in plain.affix_forms("رحمته")


def test_normal_forms(values):
    assert values(T.normalize, ("بِسْمِ اللَّهِ",)) == ["بسم الله"]
    got = values(T.query_forms, ("﴿بِسْمِ اللَّهِ﴾ (1).",))[0]
    assert tuple(got) == ("بسم الله",) * 3


def test_ligatures_and_noise(values):
    assert values(T.expand_ligatures, ("وَقَالَﷺ:",)) == ["وَقَالَ ﷺ:"]
    assert values(T.clean_noise, ("😀 نص   طويل",), ("#وسم #آخر",), ("-----",)) == ["نص طويل", "", ""]


def test_clean_translation(values):
    rows = [("Allah[1] is (2) One {3} *(4).",), ("  Guide  us .  ",), ("12",), ("2) Praise be to Allah [1].",)]
    assert values(T.clean_translation, *rows) == ["Allah is One.", "Guide us.", "", "Praise be to Allah."]


def test_brackets(values):
    rows = ["(a)", "(a", "a)", "«(a)»", "«(a»)", "", None, "﴿x﴾ [y] {z}"]
    assert values(T.unbalanced, *[(r,) for r in rows]) == [False, True, True, False, True, False, False, False]


def test_foreign_letters(values):
    rows = ["Text with كلمة inside", "Text with ﷺ and ۝ only", "صلى الله عليه وسلم", None]
    assert values(T.foreign_letters, *[(r,) for r in rows]) == ["كلمة", "", "", ""]


def test_audit_form_differs(values):
    assert values(T.audit_normalize, ("أَهْلًا، Wide-World!",)) == ["اهلا wide world"]


def test_surface(values):
    rows = [("ويقترن بتقوى الله.", "تقوي"), ("والتوكّل عليه.", "توكل"), ("فَالتَّقْوَى خَيْرُ زَادٍ.", "تقوى"), ("لا شيء", "غير")]
    assert values(T.surface, *rows) == ["بتقوى", "والتوكّل", "فَالتَّقْوَى", "غير"]


def test_languages(values):
    assert values(T.is_arabic_script, (" UR ",), ("en",), (None,)) == [True, False, False]


def test_phrase_id(spark):
    df = spark.createDataFrame([("C3", 1, 1, "خطبة: الإخلاص وخطر الرياء")], "t string, g int, o int, x string")
    assert df.select(phrase_id(*map(F.col, "tgox"))).first()[0] == "0bbedb5c-c7b8-6927-caf4-257742f1a8b4"


def test_hashed_feature(values):
    import zlib

    assert values(hashed_feature, ("pc=.",)) == [zlib.crc32(b"pc=.") & (1 << 20) - 1]
