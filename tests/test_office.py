"""Office files as tables, there and back."""

import os

import pytest
from pyspark.sql import functions as F
from test_tables import docx, para, t

from glosstream.operators import audit
from glosstream.sources import files, office


@pytest.fixture(scope="module", autouse=True)
def formats(spark):
    office.register(spark)


def test_docx(spark, tmp_path):
    notes = f'<w:footnote w:id="2"><w:p><w:r>{t("حاشية")}</w:r></w:p></w:footnote>'
    for name in ("a", "b", "c"):
        (tmp_path / f"{name}.docx").write_bytes(docx(para(t("مقدمة"), "Heading1") + para(t(f"نص {name}") + '<w:footnoteReference w:id="2"/>'), notes))
    df = spark.read.format("glosstream_docx").load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 3  # a file each
    assert df.columns == [c.split()[0] for c in "path, para, text, heading, level, styled, quoted, cover, footnotes, verses".split(", ")]
    rows = lambda d: sorted((os.path.basename(r["path"]), r["para"], r["text"], r["heading"], [tuple(n) for n in r["footnotes"]]) for r in d.collect())
    assert rows(df) == rows(files.read_docx(spark, str(tmp_path))) and rows(df)[1][4] == [("نصa", "حاشية")]
    assert df.filter("heading").select("text").distinct().count() == 1
    (tmp_path / "d.docx").write_bytes(bytes.fromhex(files.OLE2))
    with pytest.raises(Exception, match="no docx package"):
        df.sparkSession.read.format("glosstream_docx").load(str(tmp_path)).collect()
    assert spark.read.format("glosstream_docx").option("mode", "DROPMALFORMED").load(str(tmp_path)).count() == 6


def test_xlsx_there_and_back(spark, tmp_path):
    folder = str(tmp_path / "books")
    rows = [(str(i), f"نص <{i}> & \"{i}\"", None if i % 3 else "x\ny") for i in range(50)]
    df = spark.createDataFrame(rows, "id string, text string, note string").repartition(3)
    df.write.format("glosstream_xlsx").mode("overwrite").save(folder)
    names = [n for n in os.listdir(folder) if n.endswith(".xlsx")]
    assert len(names) == 3 and "_SUCCESS" in os.listdir(folder)
    read = spark.read.format("glosstream_xlsx").schema("id string, text string, note string")
    assert sorted(map(tuple, read.load(folder).collect())) == sorted(rows)
    df.filter("id = '7'").coalesce(1).write.format("glosstream_xlsx").mode("append").save(f"file://{folder}")
    assert read.load(folder).count() == 51
    df.filter("id < '2'").write.format("glosstream_xlsx").mode("overwrite").save(folder)
    assert sorted(r["id"] for r in read.load(folder).collect()) == sorted(r[0] for r in rows if r[0] < "2")
    with pytest.raises(Exception, match="lacks missing"):
        spark.read.format("glosstream_xlsx").schema("missing string").load(folder).collect()
    with pytest.raises(Exception, match="as strings"):
        spark.read.format("glosstream_xlsx").schema("id int").load(folder).collect()


def test_failed_job_leaves_nothing(spark, tmp_path):
    folder = str(tmp_path / "books")
    good = spark.createDataFrame([("1",)], "id string")
    good.write.format("glosstream_xlsx").mode("append").save(folder)
    before = sorted(os.listdir(folder))
    bad = spark.range(8).repartition(4).select(F.when(F.col("id") == 5, F.raise_error(F.lit("stop"))).otherwise(F.col("id").cast("string")).alias("id"))
    with pytest.raises(Exception, match="stop"):
        bad.write.format("glosstream_xlsx").mode("overwrite").save(folder)
    assert [n for n in sorted(os.listdir(folder)) if n != office.STAGE] == [n for n in before if n != office.STAGE]
    assert spark.read.format("glosstream_xlsx").schema("id string").load(folder).count() == 1


def test_findings_through_a_workbook(spark, tmp_path):
    """Findings of the fixed rules, written as a sheet and read again, are the same rows."""
    pairs = spark.createDataFrame([(1, "a b c (d)", "x (y"), (2, "same", "same"), (3, "one", " "), (4, "fine", "good")], "seq int, source string, target string")
    found = audit.apply_rules(pairs).select(F.col("seq").cast("string").alias("seq"), F.explode("findings").alias("f")).select("seq", "f.code", "f.explanation", F.col("f.confidence").cast("string").alias("confidence"))
    folder = str(tmp_path / "findings")
    found.coalesce(1).write.format("glosstream_xlsx").option("sheet", "findings").option("rightToLeft", "false").mode("overwrite").save(folder)
    back = spark.read.format("glosstream_xlsx").schema(found.schema).load(folder)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, found.collect())) and {r["code"] for r in back.collect()} == {"FRM-BRK", "FRM-CPY", "FRM-EMP"}
