"""DuckDB SQL for the text queries that SQL can express on whole tables."""

from __future__ import annotations

_WORDS = r"'[^\x20\x09-\x0D]+'"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SUBSTRING_DEDUP = f"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS l FROM documents),
 x AS (SELECT doc_id, i, md5(array_to_string(l[i:i + 49], ' ')) AS k FROM w, unnest(range(1, len(l) - 48)) t(i)),
 m AS (SELECT k, min(doc_id) AS first FROM x GROUP BY k),
 g AS (SELECT DISTINCT x.doc_id, unnest(range(i, i + 50)) AS j FROM x JOIN m USING (k) WHERE first < x.doc_id),
 t AS (SELECT doc_id, j, l[j] AS word FROM w, unnest(range(1, len(l) + 1)) t(j)),
 s AS (SELECT t.doc_id, count(g.j) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY t.j) FILTER (g.j IS NULL), '')) AS kept_sha256 FROM t LEFT JOIN g ON g.doc_id = t.doc_id AND g.j = t.j GROUP BY t.doc_id)
 SELECT w.doc_id, len(l) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256 FROM w LEFT JOIN s USING (doc_id)"""

MINHASH_NEARDUP = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_WORDS}) AS l FROM documents),
 s AS (SELECT DISTINCT doc_id, unnest(CASE len(l) WHEN 0 THEN [] WHEN 1 THEN l ELSE list_transform(range(1, len(l)), lambda i : l[i] || ' ' || l[i + 1]) END) AS g FROM w),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
 e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
 u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
 r AS (SELECT doc_id AS node, doc_id AS reach FROM documents UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.reach),
 c AS (SELECT node AS doc_id, min(reach) AS component_id FROM r GROUP BY node)
 SELECT w.doc_id, coalesce(n, 0) AS n_shingles, component_id, w.doc_id = component_id AS kept FROM w JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)"""

LINE_DEDUP = f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents),
 j AS (SELECT doc_id, k, line, list_sort(list_distinct(regexp_extract_all({_LOWER.replace("text", "line")}, {_WORDS}))) AS s FROM l),
 c AS (SELECT s, len(s) AS n, min({{'d': doc_id, 'k': k}}) AS first, row_number() OVER (ORDER BY min({{'d': doc_id, 'k': k}})) AS id FROM j WHERE len(s) >= 5 GROUP BY s),
 t AS (SELECT id, n, unnest(s) AS w FROM c), f AS (SELECT w, count(*) AS f FROM t GROUP BY w),
 o AS (SELECT id, n, w, row_number() OVER (PARTITION BY id ORDER BY f, w) AS r FROM t JOIN f USING (w)),
 x AS (SELECT id, n, w FROM o WHERE r <= n - (80 * n + 99) // 100 + 1),
 p AS (SELECT DISTINCT a.id AS a, b.id AS b FROM x a JOIN x b USING (w) WHERE a.id < b.id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
 i AS (SELECT a, b, y.n + z.n AS n, len(list_intersect(y.s, z.s)) AS c FROM p JOIN c y ON y.id = a JOIN c z ON z.id = b),
 g AS (SELECT DISTINCT b FROM i WHERE 100 * c >= 80 * (n - c)),
 y AS (SELECT first.d AS doc_id, first.k AS k FROM c WHERE id NOT IN (SELECT b FROM g)),
 m AS (SELECT j.doc_id, j.k, j.line, len(s) >= 5 AS judged, len(s) >= 5 AND y.k IS NULL AS gone FROM j LEFT JOIN y ON y.doc_id = j.doc_id AND y.k = j.k),
 q AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (judged) AS n_judged, count(*) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id)
 SELECT d.doc_id, CASE WHEN coalesce(d.text, '') = '' THEN 0 ELSE n_lines END AS n_lines, coalesce(n_judged, 0) AS n_judged, coalesce(n_removed, 0) AS n_removed, CASE WHEN d.text IS NOT NULL THEN kept_sha256 END AS kept_sha256 FROM documents d LEFT JOIN q USING (doc_id)"""


def _crc32(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes, bit by bit (polynomial and inversions are fixed values)."""
    size, byte = f"octet_length(encode({text}))", f"('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT"
    bits = "list_reduce(list_concat([xor(c, b)], range(8)), lambda x, k : xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range({size}), lambda i : {byte})), lambda c, b : {bits}))"


_FEATURES = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

IMPORTANCE_RESAMPLING = f"""WITH d AS (SELECT doc_id, unnest({_FEATURES}) AS w FROM documents), b AS (SELECT unnest({_FEATURES}) AS w FROM benchmark),
 v AS (SELECT w, {_crc32("w")} % 10000 AS k FROM (SELECT w FROM d UNION SELECT w FROM b)),
 s AS (SELECT k, count(*) AS n FROM d JOIN v USING (w) GROUP BY k), t AS (SELECT k, count(*) AS n FROM b JOIN v USING (w) GROUP BY k),
 g AS (SELECT v.w, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM d) + 10000) / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM b) + 10000)))) AS BIGINT) AS gain
  FROM v LEFT JOIN s USING (k) LEFT JOIN t USING (k)),
 f AS (SELECT doc_id, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM d JOIN g USING (w) GROUP BY doc_id),
 a AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT AS h FROM documents LEFT JOIN f USING (doc_id)),
 c AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM a),
 r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM c)
 SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank FROM r"""

PERIODIC_RUNS = f"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS o, {_crc32("doc_id::VARCHAR")} AS h FROM documents),
 a AS (SELECT doc_id, o, len(o) AS n, h % 10 = 0 AND len(o) > 0 AS tail, h // 10 AS g, (h // 10) % greatest(len(o), 1) AS a FROM w),
 b AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
 l AS (SELECT doc_id, n, CASE WHEN tail THEN list_transform(range(n), lambda i : CASE WHEN i < a THEN o[i + 1] ELSE o[a + (i - a) % p + 1] END) ELSE o END AS l FROM b),
 x AS MATERIALIZED (SELECT doc_id, n, i, md5(array_to_string(l[i + 1:i + 16], ' ')) AS k FROM l, unnest(range(n - 15)) t(i)),
 e AS (SELECT s.doc_id, s.i, t.i - s.i AS q FROM x s JOIN x t ON s.doc_id = t.doc_id AND s.k = t.k AND s.i < t.i WHERE 3 * (t.i - s.i) <= s.n),
 c AS (SELECT doc_id, q, min(i) AS start, count(*) + 15 + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM e) GROUP BY doc_id, q, island),
 f AS (SELECT * FROM c WHERE length >= greatest(24, 3 * q)),
 r AS (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM f s WHERE s.doc_id = f.doc_id AND s.q < f.q AND s.start <= f.start AND s.start + s.length >= f.start + f.length)),
 m AS (SELECT doc_id, count(*) AS n_runs, sha256(string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q)) AS runs_sha256 FROM r GROUP BY doc_id),
 t AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length / q DESC, start, q) = 1),
 g AS (SELECT DISTINCT doc_id, unnest(range(start + q, start + length)) AS i FROM r),
 k AS (SELECT v.doc_id, sha256(string_agg(word, ' ' ORDER BY v.i)) AS collapsed_sha256 FROM (SELECT doc_id, unnest(l) AS word, unnest(range(n)) AS i FROM l) v ANTI JOIN g ON g.doc_id = v.doc_id AND g.i = v.i GROUP BY v.doc_id)
 SELECT l.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, q AS period, 1000 * length // q AS exponent_milli, coalesce(runs_sha256, sha256('')) AS runs_sha256, coalesce(collapsed_sha256, sha256('')) AS collapsed_sha256
 FROM l LEFT JOIN m USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN k USING (doc_id)"""
