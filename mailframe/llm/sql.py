"""DuckDB SQL for the queries that SQL can express, written from their contracts and not from their code's plan."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

MIXING = rf"""
WITH d AS (SELECT doc_id, source, coalesce('s' || source, 'n') AS k, len({WORDS}) AS size, md5(concat_ws('|', '17', doc_id, source, text)) AS h FROM documents),
s AS (SELECT k, source, sum(size) AS w FROM d GROUP BY ALL),
o AS (SELECT *, CAST([5, 2, 1][CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT)] AS DOUBLE) AS wt, CAST(2 * w AS DOUBLE) AS most, CAST(1.5 * sum(w) OVER () AS DOUBLE) AS whole FROM s),
p AS (SELECT *, coalesce(sum(most) OVER (ORDER BY most / wt, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(wt) OVER (ORDER BY most / wt, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM o),
f AS (SELECT *, most <= wt * (whole - before) / rest AS stopped FROM p),
t AS (SELECT k, w, CASE WHEN stopped THEN most ELSE wt * (SELECT max(whole) - coalesce(sum(most) FILTER (stopped), 0) FROM f) / (SELECT sum(wt) FILTER (NOT stopped) FROM f) END AS target FROM f),
g AS (SELECT CAST(pow(2, floor(log2(greatest(1, sqrt((SELECT sum(w) FROM t)) / 16)))) AS BIGINT) AS shards),
b AS (SELECT shards, CAST(least(2048, pow(2, floor(log2(greatest(1, (SELECT min(target) FROM t WHERE target > 0) / (256 * shards)))))) AS BIGINT) AS block FROM g),
e AS (SELECT d.*, (CAST('0x' || substr(h, 1, 8) AS BIGINT) + row_number() OVER (PARTITION BY h, k, doc_id, size) - 1) AS n0, row_number() OVER (PARTITION BY h, k, doc_id, size) - 1 AS copy FROM d),
e2 AS (SELECT *, n0 % shards AS shard FROM e, b),
c AS (SELECT k, shard, CAST(ceil(sum(size) / any_value(block)) AS BIGINT) AS blocks, md5(concat_ws('|', '17', k, shard)) AS drawn FROM e2 GROUP BY ALL),
v AS (SELECT c.*, w, target, CAST(floor(target * blocks / greatest(w, 1) * 1048576) AS BIGINT) AS votes FROM c JOIN t USING (k)),
house AS (SELECT shard, CAST(floor(sum(votes) / 1048576 + 0.5) AS BIGINT) AS seats FROM v GROUP BY shard),
quotient AS (SELECT k, shard, votes / (2 * s + 1) AS x, s FROM (SELECT k, shard, votes, unnest(range(CAST(ceil(votes / 1048576) + (SELECT count(*) FROM t) AS BIGINT))) AS s FROM v WHERE votes > 0)),
won AS (SELECT k, shard, count(*) AS n FROM (SELECT q.*, seats, row_number() OVER (PARTITION BY shard ORDER BY x DESC, k, s) AS place FROM quotient q JOIN house USING (shard)) WHERE place <= seats GROUP BY ALL),
q AS (SELECT v.k, v.shard, w, target, greatest(blocks, 1) AS ring, least(coalesce(n, 0), 2 * blocks) AS seats, CAST('0x' || substr(drawn, 1, 8) AS BIGINT) AS first,
[2147483647, 2147483629, 2147483587, 2147483579, 2147483563, 2147483549, 2147483543, 2147483497][CAST(CAST('0x' || substr(drawn, 9, 4) AS BIGINT) % 8 + 1 AS INT)] AS step FROM v LEFT JOIN won USING (k, shard)),
x AS (SELECT e2.doc_id, e2.size, e2.block, q.w, q.target, ring, seats // ring AS rounds, seats % ring AS rest, step % ring AS step, first % ring AS first,
CAST(coalesce(sum(e2.size) OVER (PARTITION BY e2.k, e2.shard ORDER BY e2.h, e2.size, e2.doc_id NULLS FIRST, e2.copy ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS a FROM e2 JOIN q USING (k, shard)),
y AS (SELECT *, CASE WHEN size > 0 THEN list_sum(list_transform(range(a // block, (a + size - 1) // block + 1), lambda j: CASE WHEN (j * step + first) % ring < rest THEN least(a + size, (j + 1) * block) - greatest(a, j * block) ELSE 0 END)) ELSE 0 END AS part FROM x)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(w AS BIGINT) AS source_size, target, CAST(rounds * size + part AS BIGINT) AS taken FROM y"""

_U = "(CAST('0x' || substr(md5('tree|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || {name}), 1, 13) AS BIGINT) + 0.5) * pow(2, -52)"


def _race(table: str, names: str, weight: int, out: str) -> str:
    """For each id the child of ``names`` (an SQL list) with the earliest clock."""
    u = _U.format(name="name")
    return f"SELECT doc_id, arg_min(name, -ln({u}) / {weight}) AS {out} FROM (SELECT *, unnest({names}) AS name FROM {table}) GROUP BY ALL"


SHARDING = f"""
WITH crc(t) AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, CAST(n AS BIGINT)))),
ids AS (SELECT DISTINCT doc_id FROM documents),
r AS ({_race("ids", "['0', '1', '2', '3']", 10, "r")}),
k AS ({_race("r", "[r || '/0', r || '/1']", 5, "k")}),
l AS ({_race("k", "list_transform(range(5), lambda j: k || '/' || (CAST(split_part(k, '/', 1) AS INT) + 4 * (CAST(split_part(k, '/', 2) AS INT) + 2 * j)))", 1, "l")}),
late AS (SELECT doc_id, -ln({_U.format(name="'+40.40'")}) AS mine FROM ids),
root AS (SELECT doc_id, min(-ln({_U.format(name="name")}) / 10) AS theirs FROM (SELECT doc_id, unnest(['0', '1', '2', '3']) AS name FROM ids) GROUP BY doc_id),
s AS (SELECT doc_id, CAST(split_part(l, '/', 3) AS INT) AS shard, CASE WHEN mine < theirs THEN 40 ELSE CAST(split_part(l, '/', 3) AS INT) END AS grown_shard FROM l JOIN late USING (doc_id) JOIN root USING (doc_id)),
x AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
y AS (SELECT doc_id, size, xor(list_reduce(list_transform(range(size - 16), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)), lambda c, v: xor(c >> 8, t[1 + (xor(c, v) & 255)]), 4294967295), 4294967295) AS crc32 FROM x, crc),
b AS (SELECT y.*, shard, grown_shard, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || crc32), 1, 8) AS BIGINT) % CAST(pow(2, floor(log2(greatest(1, sqrt((SELECT count(*) FROM documents)) / 8)))) AS BIGINT) AS bucket FROM y JOIN s USING (doc_id))
SELECT doc_id, CAST(size AS BIGINT) AS size, crc32 AS text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id, size, crc32) - 1 AS slot, grown_shard FROM b"""

DECONTAMINATION = r"""
WITH w AS (SELECT item_id, row_number() OVER () AS r, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, r, least(5, len(w)) AS n, unnest(list_transform(range(1, len(w) - least(5, len(w)) + 2), lambda j: array_to_string(w[j:j + least(5, len(w)) - 1], ' '))) AS s FROM w WHERE len(w) > 0),
size AS (SELECT r, count(*) AS all_of FROM i GROUP BY r),
d AS (SELECT doc_id, row_number() OVER () AS q, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, q, n, unnest(list_transform(range(1, len(w) - n + 2), lambda j: array_to_string(w[j:j + n - 1], ' '))) AS s FROM d, (SELECT DISTINCT n FROM i))
SELECT doc_id, item_id, all_of AS n_shingles, count(*) AS n_shared, count(*) / all_of AS containment FROM g JOIN i USING (n, s) JOIN size USING (r) GROUP BY doc_id, q, item_id, r, all_of HAVING count(*) >= 0.8 * all_of - 1e-9"""

TOP_K = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON c.r <> q.r AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s QUALIFY rank <= 20"""

SUBSTRING = rf"""
WITH w AS (SELECT doc_id, row_number() OVER () AS r, {WORDS} AS w FROM documents),
s AS (SELECT r, unnest(range(1, len(w) - 33)) AS i, unnest(list_transform(range(1, len(w) - 33), lambda i: md5(array_to_string(w[i:i + 34], chr(31))))) AS k FROM w WHERE len(w) >= 35),
again AS (SELECT k FROM s GROUP BY k HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM s SEMI JOIN again USING (k)),
each AS (SELECT r, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM w),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM each ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (r)"""

_KINDS = (
    (0, "assign", r"""(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    (1, "access", r"AKIA[A-Z0-9]+", 0, 16),
    (2, "hex", r"[0-9a-f]+", 0, 32),
)


def _matches(number: int, kind: str, pattern: str, group: int, least: int) -> str:
    parts = f"string_split_regex(t, '{pattern}')"
    return f"""SELECT r, {number} AS k, '{kind}' AS kind, list_sum(list_transform(a[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start, length(m[i]) AS n
FROM (SELECT r, a, m, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT r, {parts} AS a, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {group}) AS g FROM d)) WHERE length(g[i]) >= {least}"""


SECRETS = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(_matches(*x) for x in _KINDS)}),
a AS (SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + n AS BIGINT), ',' ORDER BY start, k) AS spans FROM f GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans, sha256(t) AS blob FROM d LEFT JOIN a USING (r)"""

LINES = """
WITH d AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (SELECT r, unnest(range(len(l))) AS i, unnest(l) AS line FROM d),
k AS (SELECT r, i, line, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM x),
f AS (SELECT k FROM k WHERE k <> '' GROUP BY k HAVING count(DISTINCT r) >= 10),
s AS (SELECT r, count(*) AS n_lines, count(f.k) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.k IS NULL), '') AS kept FROM k LEFT JOIN f USING (k) GROUP BY r)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM d JOIN s USING (r)"""

PERIODS = rf"""
WITH crc(t) AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, CAST(n AS BIGINT)))),
d AS (SELECT doc_id, row_number() OVER () AS r, {WORDS} AS w FROM documents),
h AS (SELECT d.*, len(w) AS n, xor(list_reduce(list_transform(range(length(CAST(doc_id AS VARCHAR))), lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), CAST(i + 1 AS INT), 1)) AS BIGINT)), lambda c, v: xor(c >> 8, t[1 + (xor(c, v) & 255)]), 4294967295), 4294967295) AS h FROM d, crc),
a AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n ELSE n END AS a FROM h),
p AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM a),
u AS (SELECT r, i, CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END AS x FROM (SELECT *, unnest(range(n)) AS i FROM p)),
e AS (SELECT f.r, f.i, g.i - f.i AS q FROM u f JOIN u g ON f.r = g.r AND f.x = g.x AND g.i > f.i JOIN p ON p.r = f.r WHERE 3 * (g.i - f.i) <= n),
s AS (SELECT r, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS g FROM e) GROUP BY r, q, g HAVING count(*) + q >= greatest(24, 3 * q)),
m AS (SELECT r, start, length, min(q) AS period FROM s GROUP BY ALL),
b AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs FROM m GROUP BY r),
top AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY r ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) = 1),
gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM m),
kept AS (SELECT u.r, string_agg(x, ' ' ORDER BY u.i) AS k FROM u LEFT JOIN gone ON gone.r = u.r AND gone.i = u.i WHERE gone.r IS NULL GROUP BY u.r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(k, '')) AS collapsed_sha256
FROM d LEFT JOIN b USING (r) LEFT JOIN top USING (r) LEFT JOIN kept USING (r)"""

AUDIT = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
said AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
x AS (SELECT d.doc_id, part, good, toxic, len(w) < 100 AS "A", 100 * len(list_distinct(w)) < 80 * len(w) AS "B", 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS "C",
  regexp_matches(t, '[#$%&*|]') AS "D", coalesce(min(d.doc_id) OVER (PARTITION BY t) < d.doc_id, FALSE) AS "E" FROM d LEFT JOIN said USING (doc_id)),
f(l, i) AS (VALUES ('A', 1), ('B', 2), ('C', 3), ('D', 4), ('E', 5)),
o AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
y AS (SELECT part, good, toxic, ["A", "B", "C", "D", "E"] AS m, count(*) AS n FROM x GROUP BY ALL),
z AS (SELECT part, good, toxic, n, filter_order, CAST(step AS INT) AS step, substr(filter_order, CAST(step AS INT), 1) AS l, m[ascii(substr(filter_order, CAST(step AS INT), 1)) - 64] AS fails,
  list_bool_or(list_transform(range(1, step), lambda j: m[ascii(substr(filter_order, CAST(j AS INT), 1)) - 64])) IS TRUE AS earlier, len(list_filter(m, lambda v: v)) = 1 AS alone FROM y, o, range(1, 6) g(step)),
s AS (SELECT part, filter_order, step, l, sum(CASE WHEN NOT fails AND NOT earlier THEN n ELSE 0 END) AS kept, sum(CASE WHEN fails AND NOT earlier THEN n ELSE 0 END) AS removed, sum(CASE WHEN fails AND earlier THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN fails AND alone THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN fails AND NOT earlier AND good THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN fails AND NOT earlier AND toxic THEN n ELSE 0 END) AS toxic_lost FROM z GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, l) AS BIGINT) AS shapley FROM s"""
