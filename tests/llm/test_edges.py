"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import hashlib
import math
import zlib

import pytest

from glosstream.llm.decontaminate import contaminated, drop_contaminated
from glosstream.llm.exact_dedup import drop_exact_copies, exact_dedup
from glosstream.llm.html_extract import extract_pages
from glosstream.llm.jaccard_join import Rule, drop_near_copies, jaccard_components
from glosstream.llm.language_id import language_id
from glosstream.llm.line_dedup import line_dedup
from glosstream.llm.lm_score import lm_score
from glosstream.llm.mixing import mix, mixed_order
from glosstream.llm.quality_rank import keep_good, quality_scores
from glosstream.llm.substring_dedup import substring_dedup

CLASH = ["batch", "shard", "blob", "score", "keep_id", "digest", "point", "version", "lines", "drop", "item_id", "mix_slot", "teaches", "held_out", "round", "n", "fp", "quality"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)
LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(40_000))
PASSAGE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"


@pytest.fixture(scope="module")
def ugly(spark):
    rows = [
        (1, None, "en", "a"), (2, "", None, None), (3, "   \t\n", "en", "a"), (4, "one", "en", None), (5, LONG, "en", "b"), (6, LONG + " tail", "fr", "b"), (7, PASSAGE, "en", "a"), (8, PASSAGE.upper(), "en", "a"),
        (9, PASSAGE, "en", "c"), (9, PASSAGE, "en", "c"), (None, PASSAGE, None, None), (None, None, None, None), (10, "\n\n", "fr", "c"), (11, "Été 中文 ß 🎉 1234", "fr", "c"), (12, "12 34 !!", "fr", "c"), (13, "x" * 5000, "en", "c"),
    ]
    return spark.createDataFrame([(*r, 7, *CLASH) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (7, 1, 0), (12, 0, 0), (13, 0, 1), (13, 1, 1), (None, 1, 0), (99, 0, 0), (11, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, PASSAGE, "x"), (2, None, "x"), (3, "", "x"), (None, PASSAGE, "x"), (4, "too short", "x")], "item_id long, text string, doc_id string")


def ids(df, column="doc_id"):
    return sorted((r[column] for r in df.collect()), key=lambda x: (x is None, x))


ALL = [1, 2, 3, 4, 5, 6, 7, 8, 9, 9, 10, 11, 12, 13, None, None]


def test_pages(spark):
    rows = [(1, "u", None, "t"), (2, None, "", "t"), (3, "u", "<p>", "t"), (None, "u", "<div><p>a&#233; &amp; b, c</p><script>x</script", "t"), (5, "u", "<p>x" * 3000, "t"), (5, "u", "<div>" * 3000 + "deep", "t")]
    got = extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert [(r["page_id"], r["n_chars"]) for r in got][:3] == [(1, 0), (2, 0), (3, 0)]
    assert got[3]["text"] == "aé & b, c" and got[4]["text"] == "\n".join("x" * 3000) and got[5]["text"] == "deep"
    assert extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_exact(ugly, none):
    got = exact_dedup(ugly).collect()
    assert ids(exact_dedup(ugly)) == ALL and exact_dedup(none).count() == 0
    by = {(r["doc_id"], r["text_sha256"]): r for r in sorted(got, key=lambda r: r["kept"])}
    assert len({r["text_sha256"] for r in got}) == sum(r["kept"] for r in got)  # one of each text, repeated rows too
    empty, passage = hashlib.sha256(b"").hexdigest(), hashlib.sha256(PASSAGE.encode()).hexdigest()
    assert (by[1, empty]["keep_id"], by[1, empty]["group_size"], by[1, empty]["kept"], by[2, empty]["kept"]) == (2, 3, False, True)
    assert (by[7, passage]["keep_id"], by[7, passage]["group_size"], by[9, passage]["kept"], by[None, passage]["kept"]) == (9, 4, True, False)
    kept = drop_exact_copies(ugly)
    assert kept.columns == ugly.columns and ids(kept) == [2, 3, 4, 5, 6, 8, 9, 10, 11, 12, 13]


def test_lines(spark, ugly, none):
    assert ids(line_dedup(ugly)) == ALL and line_dedup(none).count() == 0
    assert {r["n_lines"] for r in line_dedup(ugly).filter("doc_id in (1, 2)").collect()} == {1}
    line = "A line that is long enough to be a key, at forty"
    rows = [(i, f"head {i}\n  {line.upper() if i % 2 else line}\t\n{line}") for i in range(1, 7)] + [(6, line), (None, line), (7, "short\nshort")]
    got = {(r["doc_id"], r["n_lines"]): (r["n_dropped"], r["kept_sha256"]) for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1, 3] == (2, hashlib.sha256(b"head 1").hexdigest()) and got[6, 3][0] == 0 and got[6, 1][0] == 0 and got[None, 1][0] == 0 and got[7, 2][0] == 0


def test_jaccard(ugly, none):
    got = {}
    for r in jaccard_components(ugly).collect():
        got.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"]))
    assert sum(map(len, got.values())) == len(ALL) and jaccard_components(none).count() == 0
    assert got[1] == [(0, 1)] and got[3] == [(0, 3)] and got[4] == [(1, 4)] and got[6] == [(got[5][0][0] + 1, 5)]
    assert got[8] == got[7] == [(18, 7)] and got[9] == [(18, 7)] * 2 and (18, 7) in got[None] and (0, None) in got[None]
    kept = drop_near_copies(ugly, Rule(3, 90, 100))
    assert kept.columns == ugly.columns and ids(kept) == [1, 2, 3, 4, 5, 7, 10, 11, 12, 13, None]


def test_substrings(ugly, none):
    got = {}
    for r in substring_dedup(ugly).collect():
        got.setdefault(r["doc_id"], []).append((r["n_words"], r["n_removed"]))
    assert sum(map(len, got.values())) == len(ALL) and substring_dedup(none).count() == 0
    assert got[1] == got[2] == got[3] == [(0, 0)] and got[7] == [(20, 0)] and got[8] == [(20, 0)] and got[9] == [(20, 20)] * 2 and (20, 20) in got[None]
    assert got[6][0] == (80_001, 80_000)
    text = substring_dedup(ugly, with_text=True).filter("doc_id = 6").first()
    assert text["kept_text"] == "tail" and text["kept_sha256"] == hashlib.sha256(b"tail").hexdigest()


def test_lm(ugly, none, spark):
    got = lm_score(ugly).collect()
    assert ids(lm_score(ugly)) == ALL and lm_score(none).count() == 0
    teaching = [r for r in ugly.collect() if r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2]
    n = sum(len((r["text"] or "").encode().split()) + 1 for r in teaching)
    assert {r["train_tokens"] for r in got} == {n}
    assert all(r["score"] <= 0 and math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in got)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (1, 2, 3)} == {1}


def test_language(ugly, none):
    got = {r["doc_id"]: r for r in language_id(ugly).collect() if r["doc_id"] is not None}
    assert ids(language_id(ugly)) == ALL and language_id(none).count() == 0
    assert {got[i]["lang_pred"] for i in (1, 2, 3, 10, 12)} == {"und"} and got[1]["score"] == 0
    assert got[5]["lang_pred"] in ("en", "fr") and all(0 <= r["score"] <= 1 for r in got.values())


def test_quality(ugly, none, labels, spark):
    for marks in (labels, labels.limit(0), labels.filter("quality = 1")):
        got = quality_scores(ugly, marks).collect()
        assert len(got) == len(ALL) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert quality_scores(none, labels).count() == 0
    assert keep_good(ugly, labels, threshold=0.0).count() == len(ALL) and keep_good(ugly, labels, threshold=1.1).count() == 0
    assert keep_good(ugly, labels).columns == ugly.columns
    assert 0 < keep_good(ugly, labels, quantile=0.5).count() <= len(ALL)


def test_contamination(ugly, none, benchmark):
    got = {(r["doc_id"], r["item_id"]): (r["start_token"], r["n_tokens"], r["n_matched"]) for r in contaminated(ugly, benchmark).collect()}
    assert got == {(7, 1): (0, 20, 20), (8, 1): (0, 20, 20), (9, 1): (0, 20, 20), (None, 1): (0, 20, 20)}
    kept = drop_contaminated(ugly, benchmark)
    assert kept.columns == ugly.columns and kept.count() == len(ALL) - 5
    assert contaminated(none, benchmark).count() == 0 and contaminated(ugly, benchmark.limit(0)).count() == 0
    assert contaminated(ugly, benchmark, block_tokens=3).count() == 5


def test_mixing(ugly, none):
    got = mix(ugly, block_rows=2)
    assert sorted(got.columns) == sorted([*(c for c in ugly.columns if c != "mix_slot"), "mix_slot", "mix_place", "mix_block"])
    assert ids(got) == ALL and mix(none).count() == 0
    places = [(r["mix_slot"], r["mix_place"]) for r in got.collect()]
    assert len(set(places)) == len(ALL)
    assert mixed_order(ugly, weights={"a": 3, None: 1}, block_rows=1).count() == len(ALL)


def test_pipeline_stages(spark, ugly, none, labels, benchmark, tmp_path):
    import corpus_pipeline

    labels.write.parquet(str(tmp_path / "labels.parquet"))
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        for docs in (ugly, none):
            out = stage(spark, docs, str(tmp_path))
            if name != "mix":
                assert out.columns == docs.columns
            assert out.count() <= docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontaminate", "mix"]


def test_rows_that_share_an_id_go_one_by_one(spark):
    other = "one two three four five six seven eight nine ten eleven twelve thirteen"
    rows = [(1, PASSAGE), (2, PASSAGE), (2, other), (None, PASSAGE), (None, "a clean text without any copy"), (None, "another clean one"), (3, "two three four five six seven")]
    kept = {(r["doc_id"], r["text"]) for r in drop_exact_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {rows[i] for i in (1, 2, 4, 5, 6)}
    # Rows with the same id, of which the first is a copy of a larger id's text.
    kept = {(r["doc_id"], r["text"]) for r in drop_exact_copies(spark.createDataFrame([(1, PASSAGE), (1, other), (2, PASSAGE)], "doc_id long, text string")).collect()}
    assert kept == {(1, other), (2, PASSAGE)}
    near = [(1, LONG), (2, LONG + " tail"), (2, other), (None, "a clean text without any copy"), (3, None), (3, other + " more")]
    kept = {(r["doc_id"], r["text"]) for r in drop_near_copies(spark.createDataFrame(near, "doc_id long, text string"), Rule(3, 90, 100)).collect()}
    assert kept == {near[i] for i in (0, 2, 3, 4)}
    # Rows that repeat as a whole, with other columns that differ; and near copies that only rows without id have.
    same = spark.createDataFrame([(2, PASSAGE, "x"), (2, PASSAGE, "y"), (1, PASSAGE, "z"), (None, LONG, "a"), (None, LONG + " tail", "b"), (None, LONG, "a")], "doc_id long, text string, more string")
    exact = drop_exact_copies(same).collect()
    assert sorted((r["doc_id"] or 0, len(r["text"])) for r in exact) == [(0, len(LONG)), (0, len(LONG) + 5), (2, len(PASSAGE))]
    kept = drop_near_copies(same).collect()
    assert sorted((r["doc_id"] or 0, r["text"][:5]) for r in kept) == [(0, LONG[:5]), (1, PASSAGE[:5])]
    assert {r["component_id"] for r in jaccard_components(same).filter("doc_id is null").collect()} == {None}
