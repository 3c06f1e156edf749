"""Registered queries of the corpus operators and their SQL, where SQL can express one."""

from __future__ import annotations

import public_tokenizers

from scenelake.llm import conversations, forest, hyperminhash, langid, mixing, piece_codec, positive_unlabelled, stream_dedup, suffix_dedup, token_counts, toxicity, url_filter, whitening
from scenelake.llm.tables import table


def op1_suffix_dedup(spark, sf):
    """What every document keeps when strings that an earlier one has are removed."""
    return suffix_dedup.repeated_strings(table(spark, sf, "documents")).drop("spans")


def op2_forest(spark, sf):
    """The ten nearest vectors found for every hundredth one."""
    return forest.neighbours(table(spark, sf, "embeddings"))


def op3_piece_codec(spark, sf):
    """Every document encoded and decoded again."""
    return piece_codec.digests(table(spark, sf, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_stream_dedup(spark, sf):
    """Every document with the row that stays of its equal texts."""
    return stream_dedup.deduplicated(table(spark, sf, "documents"))


def op5_near_dedup(spark, sf):
    """Every document with its class of near duplicates."""
    return hyperminhash.near_duplicates(table(spark, sf, "documents"))


def op6_source_mix(spark, sf):
    """How many words of every document the mix takes."""
    return mixing.shares(table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_url_filter(spark, sf):
    """The verdict on every page's url."""
    return url_filter.judged(table(spark, sf, "pages"))


def op8_toxicity(spark, sf):
    """How toxic every document is."""
    return toxicity.scored(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op9_language(spark, sf):
    """The language of every document."""
    return langid.identified(table(spark, sf, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_token_counts(spark, sf):
    """Token counts of every document."""
    return token_counts.token_counts(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_conversations(spark, sf):
    """Every conversation's faults and cheapest repair after damage."""
    return conversations.repaired(table(spark, sf, "conversations"))


def op12_whitening(spark, sf):
    """Every vector on the eight leading components, with unit spread."""
    return whitening.whitened(table(spark, sf, "embeddings"))


def op13_quality(spark, sf):
    """How good every document is."""
    return positive_unlabelled.scored(table(spark, sf, "documents"), table(spark, sf, "labels"))


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_forest, op3_piece_codec, op4_stream_dedup, op5_near_dedup, op6_source_mix, op7_url_filter, op8_toxicity, op9_language, op10_token_counts, op11_conversations, op12_whitening, op13_quality)}

ORACLES = {
    "op1_suffix_dedup": """
        WITH d AS (SELECT doc_id, hex(coalesce(text, '')) AS h FROM documents),
        s AS (SELECT doc_id, p, substring(h, (2 * p + 1)::BIGINT, 100) AS x FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS p FROM d)),
        f AS (SELECT x, min(doc_id) AS m FROM s GROUP BY x),
        hit AS (SELECT s.doc_id, s.p FROM s JOIN f USING (x) WHERE f.m < s.doc_id),
        new AS (SELECT doc_id, p, CASE WHEN p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 1 ELSE 0 END AS n FROM hit),
        run AS (SELECT doc_id, p, sum(n) OVER (PARTITION BY doc_id ORDER BY p) AS r FROM new),
        gone AS (SELECT doc_id, r, min(p) AS a, max(p) + 50 AS b FROM run GROUP BY doc_id, r),
        before AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS c FROM gone),
        kept AS (
            SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans,
                   string_agg(substring(h, (2 * c + 1)::BIGINT, (2 * (a - c))::BIGINT), '' ORDER BY a) || substring(any_value(h), (2 * max(b) + 1)::BIGINT) AS k
            FROM before JOIN d USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)""",
    "op4_stream_dedup": """
        WITH low AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
        groups AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM low GROUP BY text)
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(low.text) AS text_sha256
        FROM low JOIN groups USING (text)""",
    "op5_near_dedup": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents),
        sets AS (
            SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
            FROM words),
        items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
        links AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
        ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach AS (SELECT doc_id, doc_id AS other FROM sets UNION SELECT reach.doc_id, ways.b FROM reach JOIN ways ON ways.a = reach.other)
        SELECT sets.doc_id, len(s)::BIGINT AS n_shingles, m.component_id, sets.doc_id = m.component_id AS kept
        FROM sets JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) m USING (doc_id)""",
    "op11_conversations": r"""
        WITH RECURSIVE codes AS (
            SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
        given AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT) AS k
            FROM conversations),
        hit AS (
            SELECT conv_id, turn, role, text, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, k), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) % 20 AS harm
            FROM given, codes),
        harmed AS (
            SELECT conv_id, turn, role AS r, text AS x, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role,
                   CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                   unnest(range(CASE harm WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
            FROM hit),
        placed AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, sha256(x), copy) AS i FROM harmed),
        faults AS (
            SELECT *, left(role, 1) AS c, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
                   NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS b
            FROM placed),
        counts AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
                   count(*) FILTER (cut AND NOT again AND NOT blank) AS truncated, count(*) FILTER (b IS NOT NULL AND b || c NOT IN ('su', 'ua', 'au')) AS illegal
            FROM faults GROUP BY conv_id),
        put (state, audit, mid, cost, lines) AS (
            VALUES (0, '', 0, 0, ''), (0, 'I', 2, 5, 'user:' || chr(10)), (0, 'II', 3, 10, 'user:' || chr(10) || 'assistant:' || chr(10)),
                   (1, '', 1, 0, ''), (1, 'I', 2, 5, 'user:' || chr(10)), (1, 'II', 3, 10, 'user:' || chr(10) || 'assistant:' || chr(10)),
                   (2, '', 2, 0, ''), (2, 'I', 3, 5, 'assistant:' || chr(10)), (2, 'II', 2, 10, 'assistant:' || chr(10) || 'user:' || chr(10)),
                   (3, '', 3, 0, ''), (3, 'I', 2, 5, 'user:' || chr(10)), (3, 'II', 3, 10, 'user:' || chr(10) || 'assistant:' || chr(10))),
        does (mid, op, c, next) AS (
            SELECT s.range::INT, 'D', NULL::VARCHAR, s.range::INT FROM range(4) s UNION ALL VALUES (0, 'R', NULL::VARCHAR, 2), (1, 'R', NULL, 2), (2, 'R', NULL, 3), (3, 'R', NULL, 2)
            UNION ALL VALUES (0, 'K', 's', 1), (0, 'K', 'u', 2), (1, 'K', 'u', 2), (3, 'K', 'u', 2), (2, 'K', 'a', 3)),
        steps AS (
            SELECT put.state, put.audit || op AS audit, next, put.cost + CASE op WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END AS cost, lines, op, c FROM put JOIN does USING (mid)),
        way AS (
            SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS state, 0 AS cost, '' AS audit, '' AS lines FROM conversations
            UNION ALL
            SELECT conv_id, i, state, cost, audit, lines FROM (
                SELECT w.conv_id, f.i, s.next AS state, w.cost + s.cost + CASE WHEN f.cut AND s.op <> 'D' THEN 5 ELSE 0 END AS cost, w.audit || s.audit AS audit,
                       w.lines || s.lines || CASE s.op WHEN 'K' THEN f.role || ':' || f.text || chr(10) WHEN 'R' THEN CASE s.next WHEN 2 THEN 'user:' ELSE 'assistant:' END || f.text || chr(10) ELSE '' END AS lines
                FROM way w JOIN faults f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1
                JOIN steps s ON s.state = w.state AND (s.op = 'D' OR NOT (f.blank OR f.again)) AND (s.op <> 'K' OR s.c = f.c)) x
            QUALIFY row_number() OVER (PARTITION BY conv_id, state ORDER BY cost, audit) = 1),
        ends AS (
            SELECT w.conv_id, w.cost + put.cost AS cost, w.audit || put.audit AS audit, w.lines || put.lines AS lines
            FROM way w JOIN put ON put.state = w.state AND put.mid IN (0, 3) AND (put.mid = 3 OR put.state = 0) AND length(put.audit) < 3
            QUALIFY row_number() OVER (PARTITION BY w.conv_id ORDER BY w.i DESC, w.cost + put.cost, w.audit || put.audit) = 1)
        SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
               coalesce(illegal, 0)::BIGINT AS illegal, e.cost::BIGINT AS cost, e.audit, sha256(left(lines, greatest(length(lines) - 1, 0))) AS repaired_sha256
        FROM ends e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id""",
}
