from glosstream.operators import boundary, prompts, segment
from glosstream.sources import books, files
from pyspark.sql import functions as F


def test_workbooks_read_back(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2, "b & c", None), (1, 1, "أ", 0.5), (2, 1, "x", 1.0)], "doc_id long, ord int, text string, score double")
    got = {r["doc_id"]: files.sheet_rows(bytes(r["content"])) for r in books.books(rows, "doc_id", ["ord"], {"ord": "الترتيب", "text": "النص", "score": "الثقة"}).collect()}
    assert got[1] == [["الترتيب", "النص", "الثقة"], ["1", "أ", "0.5"], ["2", "b & c"]] and len(got[2]) == 2
    assert files.sheet_rows(books.audit_book([["a"]], [["b"]], [["c"]], [["d"]])) == [["a"]]
    assert books._column(0) == "A" and books._column(27) == "AB"


def test_learned_splitter():
    assert boundary.splitter({})("a b.") == []
    weights = {boundary.hashed("pc=."): 5.0, boundary.hashed("depth=1"): -50.0, boundary.hashed("tag=p"): -3.0}
    split = boundary.splitter(weights)
    assert split("One two. Three «four. five» six. Seven") == ["One two.", "Three «four. five» six.", "Seven"]
    assert segment.split_units("One two. Three «four. five» six. Seven", split) == split("One two. Three «four. five» six. Seven")
    names = [f.split("=")[0] for f in boundary.features("a b c d".split(), 2, 0, 0, "p")]
    assert len(names) == 17 and names[-2:] == ["pp", "nn"]


def test_prompts(spark):
    rows = spark.createDataFrame([("g", 2, "text", "s2", "t2", []), ("g", 1, "text", "s1", "t1", ["check"])], "group_key string, seq int, row_type string, source string, target string, hints array<string>")
    got = prompts.group_prompts(rows, "{language}: {count}\n{items}\n{extra}", "English", "no names").first()
    assert got["n"] == 2 and got["prompt"].startswith("English: 2\nid: 1\n") and "hints: check" in got["prompt"] and got["prompt"].endswith("no names") and "{" not in got["prompt"]
    df = spark.sql("select array(struct('a' as source, 'b' as target)) e, array(struct('ar' as ar, 'en' as title)) p, array() n")
    assert df.select(prompts.examples_block(F.col("e"), "Arabic", "English")).first()[0] == "Arabic: a\nEnglish: b"
    assert df.select(prompts.term_block(F.col("p"))).first()[0] == "ar → en"
