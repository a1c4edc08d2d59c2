"""Audit of translation pairs: fixed rules, hints, findings, and the bookkeeping of a run."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions import text as T
from .parse import FINDING_OUT, SEVERITIES, answered, finding, item_errors, items_of
from .ranks import median
from .stats import percent, verdict_of
from .unlike import unlike_texts


def median_ratio(pairs: DataFrame) -> DataFrame:
    """One row (n, median_ratio): target to source length where the source has 20 characters; null below ten pairs.

    The median is exact; it is found before the row is made, in a few passes of
    histograms over one number for each pair.
    """
    s, t = F.length(T.strip(F.coalesce("source", F.lit("")))), F.length(T.strip(F.coalesce("target", F.lit(""))))
    ratios = pairs.select((t / F.when(s > 0, s)).alias("r"), s.alias("s"), t.alias("t")).filter("s >= 20 and t > 0")
    n, middle = median(ratios, "r")
    return pairs.sparkSession.range(1).select(F.lit(n).cast("long").alias("n"), F.lit(middle if n >= 10 else None).cast("double").alias("median_ratio"))


def _norm(c: str) -> Column:
    return T.audit_normalize(F.col(c))


def duplicates(pairs: DataFrame, config: Config = Config()) -> DataFrame:
    """(seq, others): rows whose target also stands for a clearly different source, with the sources of the others in its group.

    Targets are compared in lower case with single spaces, from three characters
    on; a group counts only if each source has three words.  Distinct sources of
    a group are compared, as few pairs of them as settle it (see unlike.py).
    """
    key = F.lower(T.collapse(F.coalesce("target", F.lit(""))))
    keyed = pairs.select("seq", "source", key.alias("key"), _norm("source").alias("s")).filter(F.length("key") >= 3)
    groups = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.size(T.words(F.col("s"))) >= config.min_source_words).alias("long")).filter((F.col("n") >= 2) & F.col("long"))
    inside = keyed.join(groups.select("key"), "key", "left_semi")
    texts = inside.groupBy("key", "s").agg(F.min("seq").alias("first"))
    flagged = inside.join(unlike_texts(texts, config.dup_similarity), ["key", "s"], "left_semi").select("seq", "key")
    # Two samples are shown: three of a group are enough to leave one's own out.
    rank = F.row_number().over(Window.partitionBy("key").orderBy("seq"))
    first = inside.select("key", "seq", F.substring("source", 1, 40).alias("t")).withColumn("__r", rank).filter("__r <= 3")
    samples = first.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("seq", "t"))).alias("all"))
    joined = flagged.join(samples, "key")
    return joined.select("seq", F.transform(F.slice(F.filter("all", lambda x: x["seq"] != F.col("seq")), 1, 2), lambda x: x["t"]).alias("others"))


FINDING = "struct<code:string,explanation:string,location:string,confidence:int,severity:string>"


def apply_rules(pairs: DataFrame, arabic_script: bool = False, config: Config = Config()) -> DataFrame:
    """pairs(seq, source, target) with findings, hints and skip: what rules find before any model is asked.

    An empty or copied target is skipped.  Foreign letters and brackets that
    only the target leaves open are findings; an unusual length and a target
    that stands for several sources are hints.
    """
    source, target = F.coalesce("source", F.lit("")), F.coalesce("target", F.lit(""))
    empty = T.replace(target, "(?U)[\\s\\W_]+") == ""
    copied = ~empty & (_norm("source") != "") & (_norm("source") == _norm("target"))
    letters = T.foreign_letters(target)
    open_ = T.unbalanced(target) & ~T.unbalanced(source)
    make = lambda code, text, location=F.lit(""), confidence=100: F.struct(F.lit(code).alias("code"), text.alias("explanation"), location.alias("location"), F.lit(confidence).alias("confidence"), F.lit(None).cast("string").alias("severity"))
    found = F.array_compact(
        F.array(
            F.when(empty, make("FRM-EMP", F.lit("the translation is empty"))),
            F.when(copied, make("FRM-CPY", F.lit("the translation is a copy of the source"), F.substring(target, 1, 80))),
            F.when(~empty & ~copied & F.lit(not arabic_script) & (letters != ""), make("FRM-ARB", F.concat(F.lit("source letters in the translation: "), F.substring(letters, 1, 20)), F.substring(letters, 1, 20))),
            F.when(~empty & ~copied & open_, make("FRM-BRK", F.lit("a bracket is left open or closed without being opened"), confidence=90)),
        )
    )
    ratio = F.length(T.strip(target)) / F.greatest(F.length(T.strip(source)), F.lit(1))
    median = F.col("median_ratio")
    long_enough = median.isNotNull() & (F.length(T.strip(source)) >= config.min_source_chars)
    lost = F.bround((1 - ratio / median) * 100).cast("int")
    short = F.when(long_enough & (ratio < median * config.short_ratio), F.concat(F.lit("shorter than usual by "), lost.cast("string"), F.lit("%")))
    long = F.when(long_enough & (ratio > median * config.long_ratio) & ~target.rlike("[\\[(].{15,}[\\])]"), F.lit("much longer than usual"))
    twice = F.when(F.col("others").isNotNull(), F.concat(F.lit("the same translation for other sources, such as: "), F.array_join("others", "; ")))
    joined = pairs.join(duplicates(pairs, config), "seq", "left").crossJoin(F.broadcast(median_ratio(pairs).select("median_ratio")))  # one row
    skip = F.when(empty, "empty").when(copied, "copy")
    hints = F.when(skip.isNull(), F.array_compact(F.array(F.coalesce(short, long), twice))).otherwise(F.array().cast("array<string>"))
    return joined.select(*pairs.columns, found.alias("findings"), hints.alias("hints"), skip.alias("skip"))


def not_all(*conditions: Column) -> Column:
    """Are they not all true?  What is unknown is not true."""
    return ~F.coalesce(reduce(Column.__and__, conditions), F.lit(False))


def audit_rows(phrases: DataFrame, analysis: DataFrame, translations: DataFrame, *, has_key: bool, limit: int | None = None) -> DataFrame:
    """Ordered translatable phrases with their targets, numbered by document from 1.

    With an approved key, matched verses are left out; a phrase without an
    analysis stays.
    """
    joined = phrases.filter("translatable").join(analysis.select("phrase_id", "kind", "reason_code"), "phrase_id", "left").join(translations.select("phrase_id", F.col("translation").alias("target")), "phrase_id", "left")
    if has_key:
        joined = joined.filter(not_all(F.col("kind") == "quran", not_all(F.col("reason_code") == "unmatched_quran")))
    seq = F.row_number().over(Window.partitionBy("document_id").orderBy("group_id", "group_order"))
    rows = joined.select("document_id", "phrase_id", seq.alias("seq"), F.col("text").alias("source"), F.coalesce("target", F.lit("")).alias("target"), F.when(F.col("text_type") == "naqhara", "transliteration").otherwise("text").alias("row_type"))
    return rows if limit is None else rows.filter(F.col("seq") <= limit)


def with_groups(rows: DataFrame, size: int = 20) -> DataFrame:
    """Adds group_key: rows that are not skipped, in groups of ``size`` by document; null for the others."""
    asked = F.col("skip").isNull()
    n = F.row_number().over(Window.partitionBy("document_id", asked).orderBy("seq")) - 1
    return rows.withColumn("group_key", F.when(asked, F.format_string("j%d-g%05d", F.col("document_id"), F.floor(n / size))))


def groups(rows: DataFrame, size: int = 20) -> DataFrame:
    """Rows that are not skipped, with their groups; rows that have groups keep them."""
    return (rows if "group_key" in rows.columns else with_groups(rows, size)).filter("group_key is not null")


def retries(calls: DataFrame, max_attempts: int = 3) -> DataFrame:
    """(group_key, attempts, status) of calls(group_key, attempt, ok): done once a call is, failed after the last."""
    used = calls.filter(F.col("attempt") <= max_attempts).groupBy("group_key").agg(F.min(F.when(F.col("ok"), F.col("attempt"))).alias("won"), F.max("attempt").alias("last"))
    return used.select("group_key", F.coalesce("won", "last").alias("attempts"), F.when(F.col("won").isNotNull(), "done").when(F.col("last") >= max_attempts, "failed").otherwise("pending").alias("status"))


def merge_findings(rule: DataFrame, model: DataFrame) -> DataFrame:
    """Rule findings keep their numbers; model findings, which replace earlier ones, are numbered behind them."""
    last = rule.groupBy("row_id").agg(F.max("seq").alias("__last"))
    place = F.row_number().over(Window.partitionBy("row_id").orderBy("seq"))
    numbered = model.join(last, "row_id", "left").withColumn("seq", (F.coalesce("__last", F.lit(0)) + place).cast("int")).drop("__last")
    return rule.unionByName(numbered)


def run_verified(spark_rows: DataFrame, reply, size: int = 20, max_attempts: int = 3, types: dict | None = None) -> DataFrame:
    """Ask ``reply(list of row dicts) -> text`` once for each group and check its answer; failed groups are asked again.

    Gives (document_id, seq, summary, errors, attempts, status).  Calls run in
    the groups' tasks, spread over the cluster, which only look whether every
    row is answered; answers become findings in SQL functions.
    """
    import pyarrow as pa

    kind = pa.schema([("document_id", pa.int64()), ("seqs", pa.list_(pa.int32())), ("text", pa.string()), ("attempts", pa.int32()), ("status", pa.string())])

    def asked(rows: list[dict]) -> dict:
        rows, text, attempt, done = sorted(rows, key=lambda r: r["seq"]), None, 0, False
        ids = [int(r["seq"]) for r in rows]
        while not done and attempt < max_attempts:
            text, attempt = reply(rows), attempt + 1
            done = set(ids) <= answered(text)
        return {"document_id": rows[0]["document_id"], "seqs": ids, "text": text if done else None, "attempts": attempt, "status": "done" if done else "failed"}

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([asked(rows) for rows in batch.column("rows").to_pylist()], kind)

    grouped = groups(spark_rows, size)
    # A group is a row of its own few rows: a call of Python for each group would cost more than the answer.
    calls = grouped.groupBy("group_key").agg(F.collect_list(F.struct(*grouped.columns)).alias("rows")).select("rows").mapInArrow(ask, "document_id long, seqs array<int>, text string, attempts int, status string")
    # One lineage: an answer that is read twice would be asked for twice.
    rows = calls.withColumn("items", items_of(F.col("text"))).select("document_id", F.explode("seqs").alias("seq"), "items", "attempts", "status")
    item = F.try_element_at(F.filter("items", lambda x: F.trim(x["id"]).try_cast("long") == F.col("seq")), F.lit(-1))
    answer = rows.withColumn("item", item)
    done = F.col("status") == "done"
    return answer.select(
        "document_id", "seq", F.when(done, F.trim(F.coalesce("item.summary", F.lit("")))).alias("summary"), F.when(done, F.to_json(item_errors(F.col("item"), types))).alias("errors"), "attempts", "status"
    )


def row_result(errors: Column) -> dict[str, Column]:
    """What the findings of a row come to: verdict, error_count, max_severity, sensitive, needs_review."""
    scale = F.array(*map(F.lit, SEVERITIES))
    rank = F.array_max(F.transform(errors, lambda f: len(SEVERITIES) + 1 - F.array_position(scale, f["severity"]))).cast("int")
    worst = F.coalesce(F.get(scale, F.lit(len(SEVERITIES)) - rank), F.lit(""))
    return {"verdict": verdict_of(rank), "error_count": F.size(errors), "max_severity": worst, "sensitive": F.exists(errors, lambda f: f["sharia_sensitive"]), "needs_review": F.exists(errors, lambda f: f["needs_human_review"])}


def create_job(rows: DataFrame, arabic_script: bool = False, types: dict | None = None, config: Config = Config()) -> DataFrame:
    """The rows of a new job over the audit_rows of one translation.

    Findings of rules are in ``errors``.  Rows that rules settle are skipped and
    have their verdict; the others are pending, in groups.  Without rows there
    is no job: an error.
    """
    if rows.isEmpty():
        raise ValueError("the translation has no rows to audit")
    none = F.lit(None).cast("string")
    raw = lambda f: F.struct(
        f["code"].alias("code"), f["severity"].alias("severity"), none.alias("sharia_sensitive"), none.alias("detection"), f["confidence"].cast("string").alias("confidence"),
        f["location"].alias("location"), f["explanation"].alias("explanation"), none.alias("required_action"), none.alias("suggested_fix"),
    )
    ruled = apply_rules(rows, arabic_script, config).withColumn("errors", F.transform("findings", lambda f: finding(raw(f), types, "rule"))).drop("findings")
    skipped = F.col("skip").isNotNull()
    result = {k: F.when(skipped, c) for k, c in row_result(F.col("errors")).items()}
    return with_groups(ruled, config.group_size).withColumns({"status": F.when(skipped, "skipped").otherwise("pending"), "summary": F.coalesce("skip", F.lit("")), **result})


def run_job(job: DataFrame, reply, types: dict | None = None, config: Config = Config()) -> DataFrame:
    """The job's rows after its pending groups have been asked: write them before they are read twice, as each reading asks again.

    Findings of a model replace earlier ones of a model and stand behind those
    of rules.  Rows of a group that fails after its last attempt are failed.
    Rows that are done, skipped or failed are not asked again, so that a run
    over what an earlier one has written resumes it.
    """
    asked = run_verified(job.filter("status = 'pending'"), reply, config.group_size, config.max_attempts, types)
    answers = asked.select("document_id", "seq", F.col("summary").alias("__summary"), F.from_json("errors", f"array<{FINDING_OUT}>").alias("__errors"), F.col("status").alias("__status"))
    done = F.coalesce(F.col("__status") == "done", F.lit(False))
    merged = job.join(answers, ["document_id", "seq"], "left").withColumn("errors", F.when(done, F.concat(F.filter("errors", lambda f: f["source"] == "rule"), "__errors")).otherwise(F.col("errors")))
    result = {k: F.when(done, c).otherwise(F.col(k)) for k, c in row_result(F.col("errors")).items()}
    return merged.withColumns({"status": F.coalesce("__status", "status"), "summary": F.when(done, F.col("__summary")).otherwise(F.col("summary")), **result}).select(*job.columns)


def findings_of(job: DataFrame) -> DataFrame:
    """(document_id, row_seq, seq, ...): the findings of a job's rows, numbered from 1 in each row."""
    return job.select("document_id", F.col("seq").alias("row_seq"), F.posexplode("errors").alias("__pos", "__f")).select("document_id", "row_seq", (F.col("__pos") + 1).alias("seq"), "__f.*")


def finalize(job: DataFrame) -> DataFrame:
    """(document_id, status, findings, rows_<status>, groups_<status>): how the jobs stand, by their groups."""
    states = ("pending", "done", "failed")
    by_group = job.groupBy("document_id", "group_key").agg(F.max("status").alias("s"), F.sum(F.size("errors")).alias("f"), *(F.count_if(F.col("status") == s).alias(f"r_{s}") for s in (*states, "skipped")))
    in_group = F.col("group_key").isNotNull()
    counted = by_group.groupBy("document_id").agg(
        F.sum("f").alias("findings"), *(F.sum(f"r_{s}").alias(f"rows_{s}") for s in (*states, "skipped")), *(F.count_if(in_group & (F.col("s") == s)).alias(f"groups_{s}") for s in states)
    )
    total = sum((F.col(f"groups_{s}") for s in states), F.lit(0))
    return counted.withColumn("status", job_status(F.col("groups_done"), F.col("groups_failed"), total))


def statistics(rows: DataFrame, findings: DataFrame) -> DataFrame:
    """The general indicators of a job in one row, from rows(status, error_count, source, needs_review) and findings(sensitive)."""
    n = rows.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "done").alias("checked"), F.count_if(F.col("status") == "skipped").alias("skipped"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("error_count") > 0).alias("with_errors"), F.count_if("needs_review").alias("human"),
        F.coalesce(F.sum(F.when(F.col("status").isin("done", "skipped"), F.size(T.words(F.col("source"))))), F.lit(0)).alias("words"),
    )
    f = findings.agg(F.count(F.lit(1)).alias("errors"), F.count_if("sensitive").alias("sensitive"))
    both = n.crossJoin(F.broadcast(f))  # one row each
    considered = F.col("checked") + F.col("skipped")
    per = lambda scale, whole: F.when(whole > 0, F.bround(scale * F.col("errors") / whole, 2)).otherwise(0.0)
    return both.withColumns(
        {"pending": F.col("total") - F.col("checked") - F.col("skipped") - F.col("failed"), "error_rows_pct": percent(F.col("with_errors"), considered), "errors_per_100_rows": per(100.0, considered), "errors_per_1000_words": per(1000.0, F.col("words"))}
    )


def job_status(done: Column, failed: Column, total: Column) -> Column:
    """Of a job from its groups' counts; without groups there is nothing left to do."""
    return F.when((total == 0) | (done == total), "done").when(done + failed == total, F.when(done > 0, "partial").otherwise("failed")).otherwise("running")


def job_statuses(jobs: DataFrame, job_groups: DataFrame) -> DataFrame:
    """(job_id, status) of every job, those without groups too."""
    counted = job_groups.groupBy("job_id").agg(F.count(F.lit(1)).alias("t"), F.count_if(F.col("status") == "done").alias("d"), F.count_if(F.col("status") == "failed").alias("f"))
    none = lambda c: F.coalesce(c, F.lit(0))
    return jobs.select("job_id").join(counted, "job_id", "left").select("job_id", job_status(none(F.col("d")), none(F.col("f")), none(F.col("t"))).alias("status"))


def export_findings(rows: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings with the texts and place of their rows, in the order of the sheet."""
    placed = rows.select(F.col("id").alias("row_id"), F.col("seq").alias("excel_row"), "source_text", "target_text")
    return findings.join(placed, "row_id").orderBy("excel_row", "seq")
