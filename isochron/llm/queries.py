"""Queries of the corpus operators: opN_<name>, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from isochron.llm.common import table
from isochron.llm.exact_dedup import exact_dedup
from isochron.llm.fill_in_middle import middle_report
from isochron.llm.language_id import predictions
from isochron.llm.fingerprints import compared_with_next
from isochron.llm.secrets import secret_report
from isochron.llm.pieces import digest
from isochron.llm.prefix_trie import conversation_trie
from isochron.llm.sharding import shard_report
from isochron.llm.simhash import near_duplicates
from isochron.llm.line_dedup import kept_lines
from isochron.llm.html_text import extract
from isochron.llm.mixing import mix
from isochron.llm.token_counts import encoded_lengths, length_histogram


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram(encoded_lengths(table(spark, sf_dir, "documents")))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("shuffled")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(table(spark, sf_dir, "documents"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared_with_next(table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_lines(table(spark, sf_dir, "documents"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_report(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return middle_report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_token_counts": op2_token_counts,
        "op3_simhash": op3_simhash,
        "op4_language_id": op4_language_id,
        "op5_exact_dedup": op5_exact_dedup,
        "op6_fingerprints": op6_fingerprints,
        "op7_html_extraction": op7_html_extraction,
        "op8_secrets": op8_secrets,
        "op9_sentencepiece": op9_sentencepiece,
        "op10_mixing": op10_mixing,
        "op11_sharding": op11_sharding,
        "op12_prefix_trie": op12_prefix_trie,
        "op13_fill_in_middle": op13_fill_in_middle,
    }


ORACLE_SQL = {
    "op5_exact_dedup": r"""
        WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
        FROM n WINDOW w AS (PARTITION BY text_sha256)
    """,
    "op10_mixing": r"""
        WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
        w AS (SELECT *, CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS w, source_size * 2.0::DOUBLE AS cap FROM s),
        f AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS before,
                     sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_w,
                     (SELECT sum(source_size) FROM s) * 1.5::DOUBLE AS total FROM w),
        l AS (SELECT (total - before) / rest_w AS level FROM f WHERE (total - before) / rest_w * w <= cap ORDER BY before LIMIT 1),
        t AS (SELECT source, source_size, least(cap, (SELECT level FROM l) * w) AS target FROM f),
        p AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS goal,
                     sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(CAST(d.doc_id AS VARCHAR)), d.doc_id ROWS UNBOUNDED PRECEDING) - d.size AS start
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        c AS (SELECT source, sum(need) OVER (ORDER BY source NULLS LAST) - need AS lo, sum(need) OVER (ORDER BY source NULLS LAST) AS hi
              FROM (SELECT source, CAST((CAST(round(target) AS BIGINT) + 255) // 256 AS BIGINT) AS need FROM t) WHERE need > 0),
        k AS (SELECT CAST(ceil(log2(max(hi))) AS INTEGER) AS k FROM c),
        i AS (SELECT slot, list_sum([((slot >> b) & 1) << (k - 1 - b) for b in range(0, k)]) AS cell FROM k, range(CAST(2 ** k AS BIGINT)) AS r(slot)),
        s2 AS (SELECT c.source, i.slot, row_number() OVER (PARTITION BY c.source ORDER BY i.slot) - 1 AS rank FROM i JOIN c ON i.cell >= c.lo AND i.cell < c.hi),
        e AS (SELECT doc_id, source, start + epoch * source_size AS starts, least(start + epoch * source_size + size, goal) AS ends
              FROM (SELECT *, unnest([0, 1]) AS epoch FROM p WHERE size > 0)),
        x AS (SELECT e.doc_id, CAST(sum(least(ends, (rank + 1) * 256) - greatest(starts, rank * 256)) AS BIGINT) AS taken, min(slot) AS first_slot, count(*) AS n_slots
              FROM e JOIN s2 ON s2.source IS NOT DISTINCT FROM e.source AND s2.rank >= starts // 256 AND s2.rank <= (ends - 1) // 256 WHERE ends > starts GROUP BY e.doc_id)
        SELECT p.doc_id, size, source_size, target, coalesce(taken, 0) AS taken, first_slot, coalesce(n_slots, 0) AS n_slots
        FROM p LEFT JOIN x ON p.doc_id = x.doc_id
    """,
    "op11_sharding": r"""
        WITH RECURSIVE b AS (SELECT doc_id, encode(coalesce(text, '')) AS t FROM documents),
        y AS (SELECT doc_id, CAST(octet_length(t) AS BIGINT) + 1 AS size, list_transform(regexp_extract_all(hex(t), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes FROM b),
        c AS (SELECT list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1))) ORDER BY i) AS crc FROM range(256) AS r(i)),
        s AS (SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295, bytes), lambda x, z: xor(x >> 8, crc[1 + (xor(x, z) & 255)])), 4294967295) AS text_crc32 FROM y, c),
        o AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS i FROM s),
        n AS (SELECT n, a, CAST(ceil(n / a) AS BIGINT) AS b FROM (SELECT count(*) AS n, CAST(ceil(sqrt(count(*))) AS BIGINT) AS a FROM s)),
        w AS (
            SELECT i, i AS x, 0 AS k, i // b AS l, i % b AS r FROM o, n
            UNION ALL
            SELECT i, x, k, l, r FROM (
                SELECT i, k + 1 AS k, b, n,
                       CASE WHEN k % 2 = 0 THEN (l + CAST('0x' || substr(md5('1:' || k || ':' || r), 1, 15) AS BIGINT) % a) % a ELSE l END AS l,
                       CASE WHEN k % 2 = 1 THEN (r + CAST('0x' || substr(md5('1:' || k || ':' || l), 1, 15) AS BIGINT) % b) % b ELSE r END AS r,
                       CASE WHEN k = 3 THEN l * b + (r + CAST('0x' || substr(md5('1:' || k || ':' || l), 1, 15) AS BIGINT) % b) % b END AS x
                FROM (SELECT i, CASE WHEN k = 4 THEN 0 ELSE k END AS k, l, r, k = 4 AND x < n AS done, n, a, b FROM w, n) WHERE NOT done)
        )
        SELECT o.doc_id, o.size, o.text_crc32, 'rows' AS law, CAST(x % 8 AS INTEGER) AS shard, x // 8 AS slot, CAST(NULL AS INTEGER) AS grown_shard
        FROM o JOIN w ON o.i = w.i, n WHERE w.k = 4 AND w.x < n.n
    """,
    "op12_prefix_trie": r"""
        WITH RECURSIVE t AS (SELECT conv_id, turn, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS m FROM conversations WHERE conv_id IS NOT NULL),
        a AS (SELECT conv_id, list(m ORDER BY turn NULLS FIRST, m.role, m.text) AS own,
                     xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: [ord(x), 0, 0, 0, 0, 0, 0, 0]))),
                                     lambda x, z: xor(xor(x, z) >> 1, 3988292384 * (xor(x, z) & 1))), 4294967295) % 6 AS h
              FROM t GROUP BY conv_id),
        s AS (SELECT a.conv_id, list_concat(coalesce(b.own, [])[1:a.h], a.own[a.h + 1:]) AS turns FROM a LEFT JOIN a AS b ON b.conv_id = a.conv_id - a.conv_id % 100),
        p AS (SELECT conv_id, unnest(range(0, len(turns) + 1)) AS depth, turns FROM s),
        q AS (SELECT conv_id, depth, md5(CAST(turns[1:depth] AS VARCHAR)) AS node, CASE WHEN depth > 0 THEN md5(CAST(turns[1:depth - 1] AS VARCHAR)) END AS parent,
                     CASE WHEN depth > 0 THEN length(turns[depth].text) ELSE 0 END AS chars, depth = len(turns) AS ends FROM p),
        g AS (SELECT node, depth, min(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, min(chars) AS chars,
                     sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM q GROUP BY node, depth),
        k AS (SELECT parent, depth - 1 AS depth, count(*) AS n_children FROM g WHERE depth > 0 GROUP BY 1, 2),
        e AS (SELECT g.*, coalesce(n_children, 0) AS n_children FROM g LEFT JOIN k ON k.parent = g.node AND k.depth = g.depth),
        u AS (SELECT node, depth, node AS top, depth AS at FROM g UNION ALL SELECT u.node, u.depth, g.parent, u.at - 1 FROM u JOIN g ON g.node = u.top AND g.depth = u.at WHERE u.at > 0),
        v AS (SELECT u.top, u.at, CAST(count(*) FILTER (WHERE n_children = 0) AS BIGINT) AS n_leaves, CAST(sum((n_convs - 1) * chars) AS BIGINT) AS saved_tokens FROM u JOIN e USING (node, depth) GROUP BY 1, 2)
        SELECT e.conv_id, e.depth, f.conv_id AS parent_conv_id, e.n_convs, e.n_children, v.n_leaves, v.saved_tokens, e.ends_sha256
        FROM e JOIN v ON v.top = e.node AND v.at = e.depth LEFT JOIN g AS f ON f.node = e.parent AND f.depth = e.depth - 1
    """,
    "op13_fill_in_middle": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || doc_id) AS s, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u FROM documents),
        h AS (SELECT *, CAST(len(u) AS BIGINT) AS n, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(s, i, 8) AS BIGINT)) AS h FROM d),
        c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS lo, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS hi,
                     CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
        p AS (SELECT *, array_to_string(u[1:lo], '') AS a, array_to_string(u[lo + 1:hi], '') AS b, array_to_string(u[hi + 1:], '') AS z FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || b ELSE '<S>' || z || '<P>' || a || '<M>' || b END) AS output_sha256, sha256(text) AS restored_sha256
        FROM p
    """,
}
