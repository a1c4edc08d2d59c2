"""The opN_<name> queries, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import read_table, spread
from .collision_search import nearest_to_fiftieths
from .collocations import collocations
from .conversation_repair import repair_damaged
from .decontaminate import contaminated
from .exact_dedup import exact_dedup
from .html_extract import extract_pages
from .jaccard_join import jaccard_components
from .language_id import language_id
from .line_dedup import line_dedup
from .lm_score import lm_score
from .mixing import mixed_order
from .quality_rank import quality_scores
from .substring_dedup import substring_dedup


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(read_table(spark, sf_dir, name))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    docs = lambda s, d: _table(s, d, "documents")
    return {
        "op1_html_extract": lambda s, d: extract_pages(_table(s, d, "pages")),
        "op2_decontaminate": lambda s, d: contaminated(docs(s, d), _table(s, d, "benchmark")),
        "op3_quality_rank": lambda s, d: quality_scores(docs(s, d), _table(s, d, "labels")),
        "op4_pfair_mix": lambda s, d: mixed_order(docs(s, d)),
        "op5_jaccard_join": lambda s, d: jaccard_components(docs(s, d)),
        "op6_substring_rlz": lambda s, d: substring_dedup(docs(s, d)).drop("spans"),
        "op7_line_dedup": lambda s, d: line_dedup(docs(s, d)),
        "op8_exact_dedup": lambda s, d: exact_dedup(docs(s, d)),
        "op9_lm_score": lambda s, d: lm_score(docs(s, d)),
        "op10_language_id": lambda s, d: language_id(docs(s, d)),
        "op11_collocations": lambda s, d: collocations(docs(s, d)),
        "op13_conversation_repair": lambda s, d: repair_damaged(_table(s, d, "conversations")),
        "op12_collision_search": lambda s, d: nearest_to_fiftieths(_table(s, d, "embeddings")),
    }


SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

UPPER_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"


ORACLE_SQL = {
    "op5_jaccard_join": f"""
        WITH RECURSIVE w AS (SELECT doc_id, {_words(f"translate(coalesce(text, ''), {UPPER_LOWER})")} AS l FROM documents),
        sets AS (
            SELECT doc_id, CASE WHEN len(l) = 0 THEN []::VARCHAR[] WHEN len(l) < 3 THEN [array_to_string(l, ' ')]
                ELSE list_distinct(list_transform(range(1, len(l) - 1), lambda i: l[i] || ' ' || l[i + 1] || ' ' || l[i + 2])) END AS g
            FROM w
        ), s AS (SELECT doc_id, unnest(g) AS g FROM sets),
        pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        links AS (SELECT a, b FROM pairs p JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b WHERE 100 * i >= 90 * (len(x.g) + len(y.g) - i)),
        edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON r.other = e.a)
        SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, min(r.other) AS component_id FROM sets s JOIN reach r ON r.doc_id = s.doc_id GROUP BY s.doc_id, s.g""",
    "op6_substring_rlz": f"""
        WITH w AS (SELECT doc_id, {_words("coalesce(text, '')")} AS l FROM documents),
        windows AS (SELECT doc_id, i, array_to_string(l[i:i + 12], ' ') AS g FROM (SELECT doc_id, l, unnest(range(1, len(l) - 11)) AS i FROM w)),
        again AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS m FROM windows) WHERE m < doc_id),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM again),
        kept AS (
            SELECT x.doc_id, x.p, x.word, g.p IS NOT NULL AS gone
            FROM (SELECT doc_id, unnest(l) AS word, unnest(range(1, len(l) + 1)) AS p FROM w) x LEFT JOIN gone g ON g.doc_id = x.doc_id AND g.p = x.p
        ), joined AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) FILTER (NOT gone) AS t, count(*) FILTER (gone) AS n FROM kept GROUP BY doc_id)
        SELECT w.doc_id, len(l)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN joined USING (doc_id)""",
    "op7_line_dedup": f"""
        WITH lines AS (
            SELECT doc_id, pos, line, translate(trim(line, {SPACES}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))
        ), often AS (
            SELECT key, max(doc_id) AS owner FROM lines WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
        ), marked AS (
            SELECT l.*, o.key IS NOT NULL AND l.doc_id <> o.owner AS gone FROM lines l LEFT JOIN often o USING (key)
        )
        SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id""",
    "op8_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
        FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) WINDOW g AS (PARTITION BY t)""",
    "op11_collocations": f"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), {UPPER_LOWER}), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
        ), w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS l FROM pieces),
        totals AS (SELECT lang, sum(len(l))::HUGEINT AS n FROM w GROUP BY lang),
        starts AS (SELECT lang, l, unnest(range(1, len(l) + 1)) AS i FROM w),
        every AS (SELECT lang, k, array_to_string(l[i:i + k - 1], ' ') AS phrase FROM starts, range(1, 6) ks(k) WHERE i + k - 1 <= len(l)),
        f AS (SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM every GROUP BY ALL HAVING count(*) >= 100),
        cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS l FROM f WHERE k > 1),
        cuts AS (SELECT lang, k, phrase, a, c, array_to_string(l[1:c], ' ') AS x, array_to_string(l[c + 1:], ' ') AS y FROM cand, range(1, 5) cs(c) WHERE c < k),
        scored AS (
            SELECT c.lang, c.phrase, c.k, c.a, c.c, p.f AS l, q.f AS r, t.n, (1000 * c.a * t.n) // (p.f * q.f) AS score
            FROM cuts c JOIN f p ON p.lang = c.lang AND p.phrase = c.x JOIN f q ON q.lang = c.lang AND q.phrase = c.y JOIN totals t ON t.lang = c.lang
        ), lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
        inner_parts AS (
            SELECT lang, a AS longer, array_to_string(l[i:i + n - 1], ' ') AS phrase FROM cand, range(1, 5) ss(i), range(2, 5) ns(n) WHERE n < k AND i + n - 1 <= k
        ), covered AS (SELECT lang, phrase, max(longer) AS longer FROM inner_parts GROUP BY ALL),
        stay AS (SELECT s.* FROM lowest s LEFT JOIN covered v ON v.lang = s.lang AND v.phrase = s.phrase WHERE v.longer IS NULL OR 100 * v.longer < 100 * s.a)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
        FROM stay QUALIFY rank <= 2000""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
