"""The subpackage's queries, and DuckDB SQL for those that SQL expresses on whole tables."""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import DataFrame, SparkSession

from threadlens.llm import (
    brown, chat_windows, fair_mix, filter_audit, importance, line_dedup, merkle, periodic, pii, simhash, url_cascade, warc, winnowing,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        brown.op1_brown,
        winnowing.op2_winnowing,
        fair_mix.op3_fair_mix,
        warc.op4_warc,
        pii.op5_pii,
        simhash.op6_simhash,
        chat_windows.op7_chat_windows,
        importance.op8_importance,
        line_dedup.op9_line_dedup,
        merkle.op10_merkle,
        periodic.op11_periodic,
        url_cascade.op12_url_cascade,
        filter_audit.op13_filter_audit,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op3_fair_mix": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, source,
                          CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
                     CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight FROM d GROUP BY source),
        o AS (SELECT *, 2.0 * source_size / weight AS out, sum(source_size) OVER () AS total FROM s),
        w AS (SELECT *, coalesce(sum(2.0 * source_size) OVER before, 0) AS capped, sum(weight) OVER rest AS running FROM o
              WINDOW before AS (ORDER BY out, weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                     rest AS (ORDER BY out, weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
        e AS (SELECT coalesce(arg_min((1.5 * total - capped) / running, out) FILTER ((1.5 * total - capped) / running <= out), max(out)) AS finish,
                     CAST(floor(max(1.5 * total)) AS BIGINT) AS budget FROM w),
        t AS (SELECT source, source_size, weight, least(2.0 * source_size, weight * finish) AS target, budget FROM o, e),
        q AS (SELECT r, doc_id, d.source, size, source_size, weight, target, budget, sum(size) OVER (PARTITION BY d.source
                     ORDER BY md5(concat_ws(':', 42, doc_id, size)), doc_id NULLS FIRST, size, r) AS after
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        p AS (SELECT *, (after + n * source_size) / weight AS finish FROM q, (SELECT unnest([0, 1]) AS n)),
        g AS (SELECT *, coalesce(sum(size) OVER (ORDER BY finish, source NULLS LAST, n, size
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS served FROM p WHERE size > 0),
        k AS (SELECT r, CAST(sum(greatest(0, least(size, budget - served))) AS BIGINT) AS taken FROM g GROUP BY r)
        SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken, CAST(after AS DOUBLE) / weight AS virtual_finish
        FROM q LEFT JOIN k USING (r)
    """,
    "op4_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
        k AS (SELECT page_id, html, hex, max(page_id) OVER (PARTITION BY html) AS keep FROM p)
        SELECT page_id,
               CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
               (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   ((CAST('0x' || substr(hex, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT)
                     >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) + 1, 1), '' ORDER BY i) FROM range(32) t(i)) AS payload_digest,
               CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> keep THEN keep END AS refers_to
        FROM k
    """,
    # equal words at each distance, in stretches; a stretch's least distance is its period
    "op11_periodic": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
                          xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT)), lambda c, b:
                              list_reduce(CAST(range(8) AS BIGINT[]), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b)), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) AS h FROM documents),
        g AS (SELECT *, len(words) AS n, h // 10 AS g FROM d),
        a AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM g),
        w AS (SELECT r, doc_id, n, CASE WHEN a IS NULL THEN words ELSE [words[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END + 1] for i in range(n)] END AS words FROM a),
        e AS (SELECT r, unnest(words) AS w, unnest(range(n)) AS i FROM w),
        p AS (SELECT x.r, x.i, y.i - x.i AS q FROM e x JOIN e y ON x.r = y.r AND x.w = y.w AND x.i < y.i JOIN w ON w.r = x.r WHERE 3 * (y.i - x.i) <= n),
        s AS (SELECT r, q, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k, i FROM p),
        t AS (SELECT r, q, min(i) AS start, count(*) + q AS length FROM s GROUP BY r, q, k HAVING count(*) + q >= greatest(24, 3 * q)),
        u AS (SELECT r, start, length, min(q) AS period FROM t GROUP BY r, start, length),
        b AS (SELECT r, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS runs,
                     list(struct_pack(start, length, period)) AS all_runs FROM u GROUP BY r),
        o AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) AS place FROM u)
        SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256,
               sha256(array_to_string(CASE WHEN all_runs IS NULL THEN words ELSE list_filter(words, lambda w, i: len(list_filter(all_runs, lambda x: i - 1 >= x.start + x.period AND i - 1 < x.start + x.length)) = 0) END, ' ')) AS collapsed_sha256,
               n AS n_words
        FROM w LEFT JOIN b USING (r) LEFT JOIN o ON o.r = w.r AND place = 1
    """,
    "op12_url_cascade": r"""
        WITH k(prefix, verdict) AS (VALUES %s),
        u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS r FROM pages),
        f AS (SELECT r, arg_max(struct_pack(rule := prefix, verdict := verdict), length(prefix)) AS best FROM u JOIN k
              ON ('.' || host) LIKE ('%%.' || split_part(prefix, '/', 1)) AND starts_with(path, substr(prefix, strpos(prefix, '/'))) GROUP BY r)
        SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM u LEFT JOIN f USING (r)
    """
    % ", ".join(map(str, url_cascade.RULES)),
    "op13_filter_audit": r"""
        WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
        d AS (SELECT part, [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words), 100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text),
                     regexp_matches(text, '[#$%%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)] AS fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
              FROM t LEFT JOIN l USING (doc_id)),
        c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM d GROUP BY part, fails),
        o(filter_order) AS (VALUES %s), s AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM o),
        x AS (SELECT part, filter_order, step, n, good, toxic, substr(filter_order, step, 1) AS letter, fails[instr('ABCDE', substr(filter_order, step, 1))] AS now,
                     len(list_filter(range(1, step), lambda i: fails[instr('ABCDE', substr(filter_order, i, 1))])) > 0 AS before, len(list_filter(fails, lambda f: f)) = 1 AS alone FROM c CROSS JOIN s),
        g AS (SELECT part, filter_order, CAST(step AS INT) AS step, letter, coalesce(sum(n) FILTER (NOT now AND NOT before), 0) AS kept, coalesce(sum(n) FILTER (now AND NOT before), 0) AS removed,
                     coalesce(sum(n) FILTER (now AND before), 0) AS redundant, coalesce(sum(n) FILTER (now AND alone), 0) AS unique_fails,
                     coalesce(sum(good) FILTER (now AND NOT before), 0) AS good_lost, coalesce(sum(toxic) FILTER (now AND NOT before), 0) AS toxic_lost FROM x GROUP BY ALL)
        SELECT * EXCLUDE (letter) REPLACE (CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
               CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost), CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM g
    """
    % ", ".join(f"('{''.join(o)}')" for o in permutations(filter_audit.LETTERS)),
}
