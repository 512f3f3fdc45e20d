"""The queries of this package, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, html_text, ordinal_quality, packing, pii, prefix_trie, quality_rules, sentencepiece_fst, shortest_pack, turn_repair
from .jaccard_join import JaccardJoin
from .masked_lm import MaskedLm
from .substring_dedup import RepeatedSpans


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.Pii(_table(spark, sf_dir, "documents")).spans())


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_fst.digest(_table(spark, sf_dir, "documents"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RepeatedSpans(_table(spark, sf_dir, "documents")).removals()


def op6_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return MaskedLm(docs).score_words(docs)


def op7_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    # grades: 0 junk, 1 toxic, 2 clean
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2)
    out = ordinal_quality.rate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), grade)
    return out.select("doc_id", "expected_grade", "tail_prob", (F.col("tail_prob") >= 0.5).alias("kept"))


def op8_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return JaccardJoin(_table(spark, sf_dir, "documents")).membership().select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair(_table(spark, sf_dir, "conversations"))


def op12_shortest_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shortest_pack.pack(_table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(_table(spark, sf_dir, "conversations"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_pii, op2_sentencepiece, op3_html_text, op4_quality_rules, op5_substring_dedup, op6_masked_lm, op7_ordinal_quality, op8_sum_of_squares_packing, op9_jaccard_join, op10_exact_dedup, op11_turn_repair, op12_shortest_pack, op13_prefix_trie)}


#: crc32(x) of texts of ASCII characters: CRC-32 with the reflected polynomial 0xEDB88320, byte by byte.
_CRC = """
    remainders AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS r FROM (SELECT unnest(range(256)) AS i)),
    crcs AS (SELECT x, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(x, ''), lambda c: ascii(c)::BIGINT)), lambda c, b: xor(c >> 8, r[xor(c, b) % 256 + 1])), 4294967295) AS crc FROM words, remainders)
"""

ORACLE_SQL = {
    "op10_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
    "op11_turn_repair": f"""
        WITH RECURSIVE words AS (SELECT DISTINCT coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS x FROM conversations), {_CRC},
        struck AS (
            SELECT conv_id, turn, CASE crc % 20 WHEN 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
                   CASE crc % 20 WHEN 1 THEN '' WHEN 2 THEN translate(coalesce(text, ' '), '.!?', '') ELSE coalesce(text, ' ') END AS text, unnest(range(CASE crc % 20 WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END))
            FROM conversations JOIN crcs ON x = coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')
        ),
        told AS (
            SELECT *, row_number() OVER w AS n, left(role, 1) AS initial, lag(left(role, 1)) OVER w AS before,
                   rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
            FROM struck WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
        ),
        told_faults AS (
            SELECT *, bare = '' AS blank, bare <> '' AND nth > 1 AS duplicate, bare <> '' AND nth = 1 AND right(bare, 1) NOT IN ('.', '!', '?') AS truncated
            FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) AS nth FROM told)
        ),
        follows AS (SELECT unnest(['', '', 's', 'u', 'a']) AS last, unnest(['s', 'u', 'u', 'a', 'u']) AS next),
        gaps AS (  -- what inserts lead from one last initial to another
            SELECT DISTINCT last AS start, '' AS inserts, last AS stop, '' AS lines FROM follows
            UNION ALL SELECT last, 'I', next, chr(10) || CASE next WHEN 'u' THEN 'user:' ELSE 'assistant:' END FROM follows WHERE next <> 's'
            UNION ALL SELECT f.last, 'II', g.next, chr(10) || CASE f.next WHEN 'u' THEN 'user:' || chr(10) || 'assistant:' ELSE 'assistant:' || chr(10) || 'user:' END FROM follows f JOIN follows g ON g.last = f.next WHERE f.next <> 's'
        ),
        way AS (
            SELECT DISTINCT conv_id, 0::BIGINT AS n, '' AS last, 0::BIGINT AS cost, '' AS audit, '' AS lines FROM told_faults
            UNION ALL
            SELECT conv_id, n, last, best.cost, best.audit, best.lines FROM (
                SELECT w.conv_id, r.n, e.stop AS last, min({{'cost': w.cost + 2 * length(g.inserts) + e.cost, 'audit': w.audit || g.inserts || e.letter, 'lines': w.lines || g.lines || e.line}}) AS best
                FROM way w JOIN told_faults r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.n = w.n + 1 JOIN gaps g ON g.start = w.last,
                LATERAL (
                    SELECT g.stop, 3 AS cost, 'D' AS letter, '' AS line
                    UNION ALL SELECT f.next, r.truncated::INT, 'K', chr(10) || r.role || ':' || r.text FROM follows f WHERE f.last = g.stop AND f.next = r.initial AND NOT r.blank AND NOT r.duplicate
                    UNION ALL SELECT f.next, 2 + r.truncated::INT, 'R', chr(10) || CASE f.next WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || r.text FROM follows f WHERE f.last = g.stop AND f.next <> 's' AND NOT r.blank AND NOT r.duplicate
                ) e GROUP BY ALL)
        ),
        best AS (
            SELECT w.conv_id, min({{'cost': w.cost + 2 * length(g.inserts), 'audit': w.audit || g.inserts, 'lines': w.lines || g.lines}}) AS best
            FROM way w JOIN (SELECT conv_id, max(n) AS n FROM told_faults GROUP BY 1) t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.n = w.n JOIN gaps g ON g.start = w.last WHERE g.stop IN ('', 'a') GROUP BY 1
        ),
        figures AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
                   count(*) FILTER (n > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM told_faults GROUP BY 1
        )
        SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(substr(best.lines, 2), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN figures f ON f.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id
    """,
    "op13_prefix_trie": f"""
        WITH words AS (SELECT DISTINCT conv_id::VARCHAR AS x FROM conversations WHERE conv_id IS NOT NULL), {_CRC},
        own AS (SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, role, text) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
        rebuilt AS (SELECT o.conv_id, list_concat(coalesce(l.turns[:crc % 4], []), o.turns[crc % 4 + 1:]) AS path FROM own o JOIN crcs ON x = o.conv_id::VARCHAR LEFT JOIN own l ON l.conv_id = o.conv_id - o.conv_id % 20),
        paths AS (SELECT conv_id, path, unnest(range(len(path) + 1)) AS depth FROM rebuilt),
        nodes AS (
            SELECT path[:depth] AS node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(path) = depth), '') AS ends,
                   (count(*) - 1) * (CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(any_value(path[depth].text), '[^\x20\x09-\x0D]+')) END) AS saved
            FROM paths GROUP BY 1, 2
        ),
        parents AS (SELECT n.*, p.conv_id AS parent_conv_id FROM nodes n LEFT JOIN nodes p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.node = n.node[:n.depth - 1]),
        children AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM parents WHERE depth > 0 GROUP BY 1, 2),
        below AS (
            SELECT a.node, sum(d.saved) AS saved_tokens, count(*) FILTER (c.n_children IS NULL) AS n_leaves
            FROM (SELECT node, conv_id, depth, unnest(range(depth + 1)) AS up FROM nodes) d0 JOIN nodes d ON d.node = d0.node JOIN nodes a ON a.depth = d0.up AND a.node = d0.node[:d0.up]
            LEFT JOIN children c ON c.conv_id = d.conv_id AND c.depth = d.depth GROUP BY 1
        )
        SELECT p.conv_id, p.depth, p.parent_conv_id, p.n_convs, coalesce(c.n_children, 0) AS n_children, b.n_leaves, b.saved_tokens::BIGINT AS saved_tokens, sha256(p.ends) AS ends_sha256
        FROM parents p JOIN below b ON b.node = p.node LEFT JOIN children c ON c.conv_id = p.conv_id AND c.depth = p.depth
    """,
}
