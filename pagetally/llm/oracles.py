"""The operators in SQL for DuckDB, where SQL can express them at whole tables."""
from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _remainder(byte: int) -> int:
    """Of the checksum's table: eight steps of division by its polynomial, lowest bit first."""
    for _ in range(8):
        byte = byte >> 1 ^ (0xEDB88320 if byte & 1 else 0)
    return byte


NEAR_DUPLICATES = rf"""
WITH RECURSIVE words AS MATERIALIZED (
    SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i, len(w) AS n
    FROM (SELECT doc_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE text IS NOT NULL)
),
shingles AS MATERIALIZED (
    SELECT DISTINCT doc_id, g FROM (
        SELECT doc_id, w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o AS g FROM words WHERE n >= 3 WINDOW o AS (PARTITION BY doc_id ORDER BY i)
    ) WHERE g IS NOT NULL
    UNION ALL SELECT doc_id, string_agg(w, ' ' ORDER BY i) FROM words WHERE n < 3 GROUP BY doc_id
),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
),
links AS MATERIALIZED (
    SELECT c.a, c.b FROM common c JOIN sizes x ON x.doc_id = c.a JOIN sizes y ON y.doc_id = c.b WHERE 100 * c.n >= 85 * (x.n + y.n - c.n)
),
reached AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b),
least AS (SELECT a, least(a, min(b)) AS m FROM reached GROUP BY a)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, coalesce(m.m, d.doc_id) AS component_id, coalesce(m.m, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least m ON m.a = d.doc_id
"""

SHARDS = f"""
WITH sized AS (
    SELECT doc_id, strlen(coalesce(text, ''))::BIGINT + 1 AS size, hex(encode(coalesce(text, ''))) AS h, md5(coalesce(text, '')) AS digest FROM documents
),
checked AS (
    SELECT doc_id, size, digest, xor(list_reduce(
        [4294967295::BIGINT] || list_transform(range(1, 2 * size - 2, 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT),
        lambda c, b: xor(c >> 8, list_extract({[_remainder(b) for b in range(256)]}, ((xor(c, b) & 255) + 1)::BIGINT)::BIGINT)
    ), 4294967295::BIGINT) AS text_crc32 FROM sized
),
placed AS (
    SELECT *, sum(size) OVER (ORDER BY digest, doc_id ROWS UNBOUNDED PRECEDING) - size AS start, sum(size) OVER () AS total FROM checked
),
dealt AS (SELECT *, least(15, (2 * start + size) * 16 // (2 * total))::INTEGER AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY start) - 1 AS slot, NULL::INTEGER AS grown_shard FROM dealt
"""

FILL_IN_MIDDLE = r"""
WITH units AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS h,
        list_transform(regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+'), lambda u: length(u)) AS u
    FROM documents
),
drawn AS (
    SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM units
),
formed AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
            WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
    FROM drawn
),
cut AS (SELECT *, coalesce(list_sum(u[1:a]), 0)::BIGINT AS p, coalesce(list_sum(u[1:b]), 0)::BIGINT AS q FROM formed),
parts AS (SELECT *, substr(text, 1, p) AS prefix, substr(text, p + 1, q - p) AS middle, substr(text, q + 1) AS suffix FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN q - p END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM parts
"""


def _centroids(rounds: int = 10) -> str:
    """Rounds as one table after another: distances by sums over components, then floors of means by whole numbers."""

    def assigned(i: int) -> str:
        return f"""a{i} AS MATERIALIZED (
    SELECT vec_id, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
        SELECT v.vec_id, c.c, sum((v.x - c.x) * (v.x - c.x)) AS d FROM v JOIN c{i} c ON c.k = v.k GROUP BY v.vec_id, c.c
    ) GROUP BY vec_id
)"""

    tables = [r"""kept AS MATERIALIZED (
    SELECT vec_id, embedding FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
)""", """v AS MATERIALIZED (
    SELECT vec_id, generate_subscripts(embedding, 1) AS k, floor(unnest(embedding)::DOUBLE * 1024)::BIGINT AS x FROM kept
)""", """c0 AS MATERIALIZED (
    SELECT f.c, v.k, v.x FROM v JOIN (SELECT vec_id, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c FROM kept QUALIFY c < 8) f USING (vec_id)
)"""]
    for i in range(rounds):
        tables += [assigned(i), f"""c{i + 1} AS MATERIALIZED (
    SELECT c.c, c.k, coalesce((m.s - ((m.s % m.n) + m.n) % m.n) // m.n, c.x)::BIGINT AS x
    FROM c{i} c LEFT JOIN (SELECT a.c, v.k, sum(v.x) AS s, count(*) AS n FROM v JOIN a{i} a USING (vec_id) GROUP BY a.c, v.k) m ON m.c = c.c AND m.k = c.k
)"""]
    tables.append(assigned(rounds))
    return "WITH " + ",\n".join(tables) + f"""
SELECT a.vec_id, a.c::INTEGER AS cluster, a.d::BIGINT AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia,
    h.h AS centroid_sha256
FROM a{rounds} a JOIN (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY k)) AS h FROM c{rounds} GROUP BY c) h ON h.c = a.c
"""


ORACLES: dict[str, str] = {
    "op5_near_duplicates": NEAR_DUPLICATES,
    "op9_shards": SHARDS,
    "op11_fill_in_middle": FILL_IN_MIDDLE,
    "op13_centroids": _centroids(),
}
