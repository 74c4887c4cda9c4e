"""DuckDB SQL for the rows of the queries that SQL can express, where it is long."""

from __future__ import annotations


def _utf8(text: str) -> str:
    """The UTF-8 bytes of a text of code points below U+0100."""
    return (
        f"flatten(list_transform(string_split({text}, ''), lambda c: CASE WHEN unicode(c) < 128 THEN"
        " [unicode(c)::UBIGINT] ELSE [(192 + unicode(c) // 64)::UBIGINT, (128 + unicode(c) % 64)::UBIGINT] END))"
    )


def _crc32(text: str) -> str:
    """CRC-32 of a text of code points below U+0100, bit by bit."""
    bit = "lambda x, z: xor(x >> 1, 3988292384::UBIGINT * (x & 1))"
    return (
        f"xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, {_utf8(text)}),"
        f" lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), {bit})))"
    )


def _leaf(text: str) -> str:
    fields = ("doc_id", "source", "lang", "n_chars", text)
    parts = [f"coalesce(octet_length(encode({x}::VARCHAR)) || ':' || {x}::VARCHAR, '-')" for x in fields]
    return f"sha256({' || '.join(parts)})"


SPELLING = f"""
    WITH RECURSIVE runs AS (
      SELECT coalesce(doc_id::VARCHAR, '') AS id,
             unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[A-Za-zÀ-ÿ]+')) AS run
      FROM documents),
    counted AS (SELECT id, run, count(*) AS n FROM runs WHERE length(run) >= 5 GROUP BY ALL),
    hashed AS (SELECT *, {_crc32("id || ':' || run")} AS h FROM counted),
    thinned AS (
      SELECT n, CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2)
                ELSE run END AS word
      FROM hashed),
    w AS MATERIALIZED (
      SELECT word, sum(n)::BIGINT AS n FROM thinned WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
    cut AS MATERIALIZED (
      SELECT word, n, k, left(word, k - 1) || substr(word, k + 1) AS less
      FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM w)),
    pairs AS (
      SELECT a.word AS x, b.word AS y FROM cut a JOIN cut b ON a.less = b.less AND a.k = b.k AND a.word <> b.word
      UNION SELECT c.word, w.word FROM cut c JOIN w ON w.word = c.less
      UNION SELECT w.word, c.word FROM cut c JOIN w ON w.word = c.less),
    ranked AS (
      SELECT x, y, w.n, count(*) OVER (PARTITION BY x) AS n_near,
             row_number() OVER (PARTITION BY x ORDER BY w.n DESC, encode(y)) AS k
      FROM pairs JOIN w ON w.word = y),
    forms AS (
      SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near,
             CASE WHEN r.n >= 2 * w.n THEN y END AS form, CASE WHEN r.n >= 2 * w.n THEN r.n END AS form_n
      FROM w LEFT JOIN ranked r ON r.x = w.word AND r.k = 1),
    chain AS (
      SELECT word, word AS at, form AS next FROM forms
      UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN forms f ON f.word = c.next)
    SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n
    FROM forms f JOIN chain c ON c.word = f.word AND c.next IS NULL
"""

MERKLE = f"""
    WITH RECURSIVE d AS (
      SELECT *, {_crc32("doc_id::VARCHAR")} % 2 AS odd
      FROM documents),
    leaves AS (
      SELECT doc_id, coalesce('s' || source, '') AS g, {_leaf('text')} AS leaf,
             CASE WHEN odd = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf('text')} END AS now
      FROM d),
    placed AS (
      SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
             count(*) OVER (PARTITION BY g) AS n
      FROM leaves),
    t AS (
      SELECT 0 AS lvl, g, i, leaf AS h, n FROM placed
      UNION ALL
      SELECT lvl + 1, g, i // 3, sha256(string_agg(h, '' ORDER BY i)), (max(n) + 2) // 3
      FROM t WHERE n > 1 GROUP BY lvl, g, i // 3),
    subroots AS (
      SELECT g, h AS subroot, row_number() OVER (ORDER BY encode(g)) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
    u AS (
      SELECT 0 AS lvl, i, subroot AS h, n FROM subroots
      UNION ALL
      SELECT lvl + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (max(n) + 2) // 3
      FROM u WHERE n > 1 GROUP BY lvl, i // 3),
    nodes AS (SELECT g, lvl, i, h FROM t WHERE n > 1 UNION ALL SELECT NULL, lvl, i, h FROM u WHERE n > 1),
    sides AS (
      SELECT a.g, a.lvl, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l,
             coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
      FROM nodes a JOIN nodes b ON a.g IS NOT DISTINCT FROM b.g AND a.lvl = b.lvl AND a.i // 3 = b.i // 3
      GROUP BY ALL),
    low AS (
      SELECT g, i AS leaf_i, 0 AS lvl, i, now AS h, '' AS proof, n FROM placed
      UNION ALL
      SELECT w.g, leaf_i, w.lvl + 1, w.i // 3, sha256(l || h || r), proof || l || r, (n + 2) // 3
      FROM low w JOIN sides s ON s.g = w.g AND s.lvl = w.lvl AND s.i = w.i WHERE n > 1),
    high AS (
      SELECT w.g, leaf_i, 0 AS lvl, s.i, h, proof, s.n FROM low w JOIN subroots s USING (g) WHERE w.n = 1
      UNION ALL
      SELECT w.g, leaf_i, w.lvl + 1, w.i // 3, sha256(l || h || r), proof || l || r, (n + 2) // 3
      FROM high w JOIN sides s ON s.g IS NULL AND s.lvl = w.lvl AND s.i = w.i WHERE n > 1)
    SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified
    FROM placed p JOIN subroots USING (g) JOIN high ON high.g = p.g AND leaf_i = p.i AND high.n = 1
    CROSS JOIN (SELECT h AS root FROM u WHERE n = 1)
"""
