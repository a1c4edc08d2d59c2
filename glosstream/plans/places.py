"""Places, order and facets over the driver's tables, each with the same statement in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import align, audit, decide, export, stats
from ..streaming import claims
from .relational import PARAGRAPHS, paragraphs_of, plain_form, plain_sql, query, table

#: Sentences of paragraphs as segments, and three notes for each paragraph.
SEGMENTS = f"""
    {PARAGRAPHS}, pieces AS (SELECT doc_id, para, unnest(range(1, len(l) + 1)) AS ord, unnest(l) AS content FROM (SELECT doc_id, para, string_split(text, '. ') AS l FROM paras)),
    s AS (SELECT *, regexp_replace(regexp_replace(content, '\\s*\\(\\s*\\)', '', 'g'), '[\\s«»]', '', 'g') AS letters FROM pieces),
    j AS (SELECT doc_id, para, string_agg(letters, '' ORDER BY ord) AS joined FROM s GROUP BY ALL),
    a AS (SELECT *, substring(joined, 20, 16) AS a1, substring(joined, 10, 16) AS a2, CASE WHEN para % 2 = 1 THEN '' ELSE substring(joined, 50, 8) END AS a3 FROM j)"""


def _segments(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    paras = paragraphs_of(table(spark, folder, "documents"))
    segments = paras.select("doc_id", "para", F.posexplode(F.split("text", "[.] ")).alias("ord", "content")).withColumn("ord", F.col("ord") + 1)
    joined = F.array_join(F.transform(F.split("text", "[.] "), align.letters), "")
    anchors = F.array(F.substring("joined", 20, 16), F.substring("joined", 10, 16), F.when(F.col("para") % 2 == 1, "").otherwise(F.substring("joined", 50, 8)))
    notes = paras.select("doc_id", "para", joined.alias("joined")).select("doc_id", "para", F.posexplode(anchors).alias("n", "anchor")).select("doc_id", "para", (F.col("n") + 1).cast("long").alias("n"), "anchor")
    return segments, notes


@query(
    f"""WITH {SEGMENTS},
    e1 AS (SELECT *, CASE WHEN a1 = '' THEN -1 WHEN strpos(joined, a1) > 0 THEN strpos(joined, a1) + len(a1) - 1 ELSE 0 END AS x1 FROM a),
    e2 AS (SELECT *, greatest(x1, 0) AS b1, strpos(substring(joined, greatest(x1, 0) + 1), a2) AS p2 FROM e1),
    f2 AS (SELECT *, CASE WHEN a2 = '' THEN -1 WHEN p2 > 0 THEN b1 + p2 + len(a2) - 1 ELSE 0 END AS x2 FROM e2),
    e3 AS (SELECT *, greatest(b1, x2) AS b2, strpos(substring(joined, greatest(b1, x2) + 1), a3) AS p3 FROM f2),
    f3 AS (SELECT *, CASE WHEN a3 = '' THEN -1 WHEN p3 > 0 THEN b2 + p3 + len(a3) - 1 ELSE 0 END AS x3 FROM e3),
    ends AS (SELECT doc_id, para, unnest([1, 2, 3])::BIGINT AS n, unnest([x1, x2, x3]) AS x FROM f3),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY para, n) AS number FROM ends),
    sums AS (SELECT *, sum(len(letters)) OVER w AS stop, row_number() OVER w AS r, count(*) OVER (PARTITION BY doc_id, para) AS c FROM s WINDOW w AS (PARTITION BY doc_id, para ORDER BY ord)),
    hosts AS (SELECT n.*, ord, content, stop - len(letters) AS start FROM numbered n JOIN sums USING (doc_id, para) WHERE CASE WHEN x > 0 THEN x > stop - len(letters) AND x <= stop WHEN x = 0 THEN r = c ELSE r = 1 END)
    SELECT doc_id, para, n, number::INT AS number, ord::INT AS ord,
        CASE WHEN x > 0 THEN list_filter(range(1, len(content) + 1), lambda i: NOT regexp_matches(content[i], '[\\s«»]'))[(x - start)::BIGINT] WHEN x = 0 THEN len(content) ELSE 0 END::INT AS at FROM hosts"""
)
def note_places(spark: SparkSession, folder: str) -> DataFrame:
    """Three notes a paragraph, in the sentences of all documents: one anchor behind the other, one before it, one empty or short."""
    return align.place_notes(*_segments(spark, folder))


@query(
    f"""WITH {PARAGRAPHS}, w AS (SELECT doc_id, para, string_split({plain_sql('text')}, ' ') AS l FROM paras),
    canon AS (SELECT doc_id, list(x ORDER BY para, i) AS l FROM (SELECT doc_id, para, unnest(l) AS x, unnest(range(len(l))) AS i FROM w) GROUP BY doc_id),
    q AS (SELECT doc_id, para, list_transform(l[2:9], lambda x, i: CASE WHEN i = 3 THEN 'misread' ELSE x END) AS l FROM w WHERE len(l) >= 9),
    qw AS (SELECT doc_id, para, unnest(l) AS x, unnest(range(8)) AS q FROM q), cw AS (SELECT doc_id, unnest(l) AS x, unnest(range(len(l))) AS c, len(l) AS n FROM canon),
    d AS (SELECT doc_id, para, c - q AS start, count(*) AS hits FROM qw JOIN cw USING (doc_id, x) WHERE c - q >= 0 AND c - q + 8 <= n GROUP BY ALL)
    SELECT doc_id, para, start::INT AS start, 8 AS n_words, 100.0::DOUBLE * hits / 8 AS score FROM d WHERE hits >= 6.8 QUALIFY row_number() OVER (PARTITION BY doc_id, para ORDER BY hits DESC, start) = 1"""
)
def window_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Eight words of each paragraph, one of them misread, in the words of their document."""
    forms = paragraphs_of(table(spark, folder, "documents")).select("doc_id", "para", plain_form(F.col("text")).alias("form"))
    # Forms are gathered whole and split then: lists of words take twice their room.
    in_order = F.array_sort(F.collect_list(F.struct("para", "form")))
    corpus = forms.groupBy(F.col("doc_id").alias("group")).agg(F.split(F.array_join(in_order["form"], " "), " ").alias("words"))
    read = F.transform(F.slice("words", 2, 8), lambda w, i: F.when(i == 2, "misread").otherwise(w))
    words = forms.select("doc_id", "para", F.split("form", " ").alias("words"))
    queries = words.filter(F.size("words") >= 9).select("doc_id", "para", F.col("doc_id").alias("group"), read.alias("words"))
    return align.aligned_windows(queries, corpus, ["doc_id", "para"], similarity=lambda a, b: F.when(a == b, 100.0).otherwise(0.0), unlike=0.0)


@query(
    """WITH RECURSIVE t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, length(text) AS n,
        CASE WHEN role = 'system' THEN 'title' WHEN length(text) % 3 = 0 THEN 'attribution' WHEN contains(text, '!') THEN 'call' ELSE 'text' END AS plain,
        CASE WHEN role = 'system' THEN 'title' WHEN length(text) % 2 = 0 THEN 'quote' WHEN length(text) % 3 = 0 OR length(text) % 5 = 0 THEN 'attribution' ELSE 'text' END AS behind FROM conversations),
    walk AS (SELECT conv_id, turn, i, plain AS kind FROM t WHERE i = 1 UNION ALL SELECT t.conv_id, t.turn, t.i, CASE WHEN w.kind = 'attribution' THEN t.behind ELSE t.plain END FROM walk w JOIN t ON t.conv_id = w.conv_id AND t.i = w.i + 1)
    SELECT conv_id, turn, kind FROM walk"""
)
def decision_list(spark: SparkSession, folder: str) -> DataFrame:
    """What each turn is, where that may depend on what the turn before became."""
    n, system = F.length("text"), F.col("role") == "system"
    plain = decide.first_of([(system, "title"), (n % 3 == 0, "attribution"), (F.contains("text", F.lit("!")), "call")], "text")
    behind = decide.first_of([(system, "title"), (n % 2 == 0, "quote"), ((n % 3 == 0) | (n % 5 == 0), "attribution")], "text")
    return decide.decide(table(spark, folder, "conversations"), ["conv_id"], ["turn"], plain, behind, "attribution").select("conv_id", "turn", "kind")


#: Orders as translation pairs: sources are one phrase over and over, so that their likeness is a matter of lengths.
ORDER_PAIRS = """p AS (SELECT o_orderkey AS seq, CASE o_orderkey % 7 WHEN 3 THEN repeat('t', 200) || (o_custkey % 50) WHEN 4 THEN 'x' ELSE 'to customer number ' || o_custkey END AS target,
    repeat('alpha beta gamma ', [1, 2, 5, 10][o_orderkey % 4 + 1]) AS source FROM orders)"""
FLAGGED = """n AS (SELECT *, trim(source) AS s, lower(target) AS k FROM p WHERE length(target) >= 3), lengths AS (SELECT DISTINCT k, length(s) AS l FROM n),
    unlike AS (SELECT DISTINCT a.k, a.l FROM lengths a JOIN lengths b ON a.k = b.k AND 2.0 * least(a.l, b.l) / (a.l + b.l) < 0.55),
    ranked AS (SELECT k, seq, source[1:40] AS t, row_number() OVER (PARTITION BY k ORDER BY seq) AS r FROM n),
    flagged AS (SELECT n.seq, n.k FROM n JOIN unlike u ON u.k = n.k AND u.l = length(n.s)),
    told AS (SELECT f.seq, string_agg(r.t, '; ' ORDER BY r.seq) AS others FROM flagged f JOIN ranked r ON r.k = f.k AND r.seq <> f.seq AND r.r <= CASE WHEN f.seq <= (SELECT max(x.seq) FROM ranked x WHERE x.k = f.k AND x.r = 2) THEN 3 ELSE 2 END GROUP BY f.seq)"""


def _order_pairs(spark: SparkSession, folder: str) -> DataFrame:
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    target = F.when(key % 7 == 3, F.concat(F.repeat(F.lit("t"), F.lit(200)), (customer % 50).cast("string"))).when(key % 7 == 4, "x").otherwise(F.concat(F.lit("to customer number "), customer.cast("string")))
    times = F.element_at(F.array(*map(F.lit, (1, 2, 5, 10))), (key % 4 + 1).cast("int"))
    return table(spark, folder, "orders").select(key.alias("seq"), F.repeat(F.lit("alpha beta gamma "), times).alias("source"), target.alias("target"))


@query(f"WITH {ORDER_PAIRS}, {FLAGGED} SELECT seq, others FROM told")
def duplicate_hints(spark: SparkSession, folder: str) -> DataFrame:
    """Orders whose target stands for clearly different sources, with two others of its group."""
    return audit.duplicates(_order_pairs(spark, folder)).select("seq", F.array_join("others", "; ").alias("others"))


@query(
    f"""WITH {ORDER_PAIRS}, {FLAGGED}, m AS (SELECT median(length(target) / length(trim(source))) AS m FROM p WHERE length(trim(source)) >= 20),
    r AS (SELECT p.*, m, length(trim(source)) AS ls, length(target) / greatest(length(trim(source)), 1) AS r FROM p, m)
    SELECT r.seq, concat_ws('|', CASE WHEN ls >= 40 AND r < m * 0.4 THEN 'shorter than usual by ' || round_even((1 - r / m) * 100, 0)::INT || '%' WHEN ls >= 40 AND r > m * 3.0 THEN 'much longer than usual' END,
        CASE WHEN others IS NOT NULL THEN 'the same translation for other sources, such as: ' || others END) AS hints FROM r LEFT JOIN told USING (seq)"""
)
def rule_hints(spark: SparkSession, folder: str) -> DataFrame:
    """The hints of the fixed rules: unusual lengths against the exact median, and targets that stand for several sources."""
    return audit.apply_rules(_order_pairs(spark, folder)).select("seq", F.array_join("hints", "|").alias("hints"))


@query("SELECT word, count(*)::BIGINT AS n, row_number() OVER (ORDER BY count(*) DESC, word) AS place FROM (SELECT unnest(string_split(lower(text), ' ')) AS word FROM documents) GROUP BY word")
def word_places(spark: SparkSession, folder: str) -> DataFrame:
    """All words of the documents by falling count, numbered over the whole table."""
    return stats.most_common(table(spark, folder, "documents").select(F.explode(F.split(F.lower("text"), " ")).alias("word")), ["word"])


@query(
    """WITH j AS (SELECT o.*, c_mktsegment, n_name FROM orders o LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey WHERE o_orderpriority ILIKE '%urgent%' OR n_name ILIKE '%urgent%' OR o_orderstatus ILIKE '%urgent%')
    SELECT 'status' AS facet, o_orderstatus AS value, count(*)::BIGINT AS n FROM j GROUP BY 2 UNION ALL SELECT 'segment', c_mktsegment, count(*) FROM j GROUP BY 2 UNION ALL SELECT 'nation', n_name, count(*) FROM j GROUP BY 2
    UNION ALL SELECT 'year', strftime(o_orderdate, '%Y'), count(*) FROM j GROUP BY 2 UNION ALL SELECT 'month', strftime(o_orderdate, '%Y-%m'), count(*) FROM j GROUP BY 2 UNION ALL SELECT 'day', strftime(o_orderdate, '%Y-%m-%d'), count(*) FROM j GROUP BY 2"""
)
def joined_facets(spark: SparkSession, folder: str) -> DataFrame:
    """Orders found by own and joined columns, with facets of both and the hierarchy of their dates."""
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderpriority", "o_orderstatus", "o_orderdate")
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_mktsegment")
    nations = table(spark, folder, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    found = export.search(orders.join(customers, "o_custkey", "left").join(nations, "c_nationkey", "left"), "Urgent", ["o_orderpriority", "n_name", "o_orderstatus"])
    return export.faceted(found, {"status": "o_orderstatus", "segment": "c_mktsegment", "nation": "n_name"}, date="o_orderdate")


@query(
    """WITH f AS (SELECT user_id, min({'at': ts, 'open': event_type NOT IN ('signup', 'purchase')}) AS f FROM events GROUP BY user_id)
    SELECT user_id::VARCHAR AS id, 1 AS attempt FROM f WHERE f.open"""
)
def queued_once(spark: SparkSession, folder: str) -> DataFrame:
    """Users whose first event is still open: what the stream of claims queues, over the whole table."""
    events = table(spark, folder, "events").select(F.col("user_id").alias("id"), F.col("ts").alias("at"), F.col("event_type").alias("status"))
    return claims.first_rows(events, ("signup", "purchase"))


@query(
    """WITH latest AS (SELECT o_custkey AS id, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY o_custkey)
    SELECT c_custkey AS id FROM customer LEFT JOIN latest ON id = c_custkey WHERE coalesce(status, '') <> 'F'"""
)
def resumed_work(spark: SparkSession, folder: str) -> DataFrame:
    """Customers whose last order is not finished: what a run that is started again has left to do."""
    results = table(spark, folder, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("at"), F.col("o_orderstatus").alias("status"))
    return claims.resumable(table(spark, folder, "customer").select(F.col("c_custkey").alias("id")), results, ("F",))
