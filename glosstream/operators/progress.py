"""Progress of documents and their translations, in one plan whatever the number of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Stage and base progress.
SAVED_STAGE, SAVED_PROGRESS = 2, 40
STAGE_OF_STATUS = {"pending": 3, "translating": 3, "review": 4, "approved": 5, "archived": 5}


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("int")


def share(part: Column, total: Column) -> Column:
    return F.when(total > 0, part / total).otherwise(0.0)


def translation_progress(status: Column, translated: Column, approved: Column, total: Column) -> Column:
    """40 for a saved document, 20 more by what is translated, 20 by what is approved, 100 once approved or archived."""
    return (
        F.when(status.isin("approved", "archived"), 100)
        .when(status == "review", half_up(60 + 20 * share(approved, total)))
        .when(status == "translating", half_up(SAVED_PROGRESS + 20 * share(translated, total)))
        .otherwise(SAVED_PROGRESS)
    )


def counts(translations: DataFrame, phrases: DataFrame, phrase_translations: DataFrame) -> DataFrame:
    """Translations with translated, approved and total; phrases that need no translation count nowhere.

    Counts are made before the joins, so that none of them multiplies rows.
    """
    live = phrases.filter("translatable").select("phrase_id", "document_id")
    total = live.groupBy("document_id").agg(F.count(F.lit(1)).alias("total"))
    done = phrase_translations.join(live.select("phrase_id"), "phrase_id").groupBy("dt_id").agg(F.count_if(F.col("translation") != "").alias("translated"), F.count_if(F.col("status") == "approved").alias("approved"))
    joined = translations.join(done, F.col("id") == F.col("dt_id"), "left").join(total, "document_id", "left").drop("dt_id")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("translated", "approved", "total")})


def translation_rows(translations: DataFrame) -> DataFrame:
    """Adds progress and stage_index to translations with status and counts."""
    stage = F.element_at(F.create_map(*(F.lit(x) for kv in STAGE_OF_STATUS.items() for x in kv)), F.col("status"))
    return translations.withColumns({"progress": translation_progress(F.col("status"), F.col("translated"), F.col("approved"), F.col("total")), "stage_index": stage})


def document_progress(documents: DataFrame, rows: DataFrame) -> DataFrame:
    """stage_index (the slowest language that is not archived), progress (the mean of all) and languages of each document."""
    live = F.min(F.when(F.col("status") != "archived", F.col("stage_index")))
    rolled = rows.groupBy("document_id").agg(F.coalesce(live, F.min("stage_index")).alias("s"), half_up(F.avg("progress")).alias("p"), F.count(F.lit(1)).alias("n"), F.max_by("status", "id").alias("latest"))
    joined = documents.join(rolled, "document_id", "left")
    return joined.select(*documents.columns, F.coalesce("s", F.lit(SAVED_STAGE)).alias("stage_index"), F.coalesce("p", F.lit(SAVED_PROGRESS)).alias("progress"), F.coalesce("n", F.lit(0)).alias("languages"), F.coalesce("latest", F.lit("classified")).alias("latest_status"))


def polling_percent(done: Column, total: Column) -> Column:
    """2 plus 94 by what is done, half to even."""
    return (2 + F.bround(94 * done / F.greatest(total, F.lit(1)))).cast("int")
