"""SQL of the operators that SQL can express, for the given tables."""

from __future__ import annotations

_LOWER = "translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER.format(text='text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = {
    "op3_topk": """
        WITH sound AS (
            SELECT vec_id, [floor(64 * CAST(x AS DOUBLE)) for x in embedding] AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0
              AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
            FROM sound q JOIN sound c ON q.vec_id <> c.vec_id
            WHERE q.vec_id % 20 = 0
        ), placed AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
            FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM placed WHERE rank <= 20
    """,
    "op11_decontaminate": f"""
        WITH dw AS MATERIALIZED (
            SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents
        ), iw AS MATERIALIZED (
            SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w, least(10, len(w)) AS k FROM benchmark
        ), windows AS MATERIALIZED (
            SELECT DISTINCT item_id, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS s
            FROM iw, unnest(range(1, len(w) - k + 2)) AS t(i) WHERE k > 0
        ), places AS (
            SELECT r, i, sizes.k, array_to_string(list_slice(w, i, i + sizes.k - 1), ' ') AS s
            FROM dw, (SELECT DISTINCT k FROM windows) AS sizes, unnest(range(1, len(w) - sizes.k + 2)) AS t(i)
        ), hits AS MATERIALIZED (
            SELECT r, i, k, item_id FROM places JOIN windows USING (k, s)
        ), covered AS (
            SELECT r, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + k)) AS t(p) GROUP BY r
        ), items AS (
            SELECT r, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS sha
            FROM (SELECT DISTINCT r, item_id FROM hits WHERE item_id IS NOT NULL) GROUP BY r
        )
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
               CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(sha, sha256('')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AS contaminated
        FROM dw LEFT JOIN covered USING (r) LEFT JOIN items USING (r)
    """,
    "op12_ranked": f"""
        WITH docs AS MATERIALIZED (
            SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents
        ), sized AS (
            SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n FROM docs WHERE len(w) > 0
        ), totals AS (
            SELECT count(*) AS c, CAST(sum(n) AS BIGINT) AS total FROM sized
        ), counted AS MATERIALIZED (
            SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM docs) GROUP BY ALL
        ), weights AS MATERIALIZED (
            SELECT term, CAST(floor(1000 * ln((2 * CAST(c AS DOUBLE) + 2) / (2 * CAST(df AS DOUBLE) + 1))) AS BIGINT) AS weight
            FROM (SELECT term, count(*) AS df FROM counted GROUP BY term), totals
        ), impacts AS MATERIALIZED (
            SELECT doc_id, r, term,
                   weight * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * c) // total))) AS part
            FROM counted JOIN sized USING (r) JOIN weights USING (term), totals
        ), asked AS (
            SELECT DISTINCT item_id, text, unnest({_WORDS}) AS term FROM benchmark
        ), scored AS (
            SELECT item_id, text, r, doc_id, CAST(sum(part) AS BIGINT) AS score
            FROM asked JOIN impacts USING (term) GROUP BY ALL
        ), placed AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id) AS INTEGER) AS rank
            FROM scored WHERE score > 0
        )
        SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 50
    """,
    "op13_repeats": r"""
        WITH raw AS (
            SELECT row_number() OVER () AS r, doc_id,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                   4294967295 - list_reduce(
                       flatten(list_prepend([CAST(4294967295 AS BIGINT)],
                           [[CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]
                            for x in string_split(CAST(doc_id AS VARCHAR), '')])),
                       lambda c, x: CASE WHEN x >= 0 THEN xor(c, x)
                                      ELSE xor(c >> 1, CAST(3988292384 AS BIGINT) * (c & 1)) END) AS h
            FROM documents
        ), marked AS (
            SELECT *, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS plant,
                   CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM raw
        ), docs AS MATERIALIZED (
            SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM marked
        ), words AS MATERIALIZED (
            SELECT r, i, w[CASE WHEN plant AND i >= a THEN a + (i - a) % p ELSE i END + 1] AS word
            FROM docs, unnest(range(0, n)) AS t(i)
        ), grid AS (
            SELECT r, n, q, unnest(range(0, (n - 1) // q)) AS k
            FROM (SELECT r, n, unnest(range(1, n // 4 + 1)) AS q FROM docs WHERE n > 3)
        ), equal AS (
            SELECT g.r, g.n, q, k FROM grid g
            JOIN words x ON x.r = g.r AND x.i = k * q
            JOIN words y ON y.r = g.r AND y.i = k * q + q AND y.word = x.word
        ), followed AS (
            SELECT r, n, q, lead(k, 2) OVER (PARTITION BY r, q ORDER BY k) - k AS step FROM equal
        ), candidates AS MATERIALIZED (
            SELECT DISTINCT r, n, q FROM followed WHERE step = 2
        ), same AS (
            SELECT c.r, q, x.i, x.i - row_number() OVER (PARTITION BY c.r, q ORDER BY x.i) AS island
            FROM candidates c JOIN words x ON x.r = c.r JOIN words y ON y.r = c.r AND y.i = x.i + q AND y.word = x.word
        ), stretches AS (
            SELECT r, q, min(i) AS s, count(*) + q AS len FROM same GROUP BY r, q, island
        ), runs AS MATERIALIZED (
            SELECT r, s, len, min(q) AS q FROM stretches WHERE len >= greatest(6, 4 * q) GROUP BY r, s, len
        ), told AS (
            SELECT r, count(*) AS n_runs,
                   string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY r
        ), longest AS (
            SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY len DESC, s, q) AS place FROM runs)
            WHERE place = 1
        ), dropped AS (
            SELECT DISTINCT r, unnest(range(s + q, s + len)) AS i FROM runs
        ), kept AS (
            SELECT r, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN dropped USING (r, i) GROUP BY r
        )
        SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(s AS BIGINT) AS start,
               CAST(len AS BIGINT) AS length, CAST(q AS BIGINT) AS period,
               CAST(1000 * len // q AS BIGINT) AS exponent_milli,
               sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
        FROM docs LEFT JOIN told USING (r) LEFT JOIN longest USING (r) LEFT JOIN kept USING (r)
    """,
}
