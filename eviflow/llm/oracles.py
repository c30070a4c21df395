"""SQL twins of the operators' queries, where SQL can express them."""

from __future__ import annotations

from eviflow.llm.sharding import RACKS, REGIONS, tree

WORDS = "regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+')"

NEAREST = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_prepend(0.0::DOUBLE, list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])), lambda a, b: a + b) AS score
  FROM u q JOIN u c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""


def _draw(level: str, children: list[int]) -> str:
    """The child with the least weighted draw."""
    u = lambda c: f"(CAST('0x' || substr(md5('{level}{c}:' || k), 1, 13) AS BIGINT) + 1)::DOUBLE / {1 << 52}::DOUBLE"
    draws = [f"{{'at': -ln({u(c)}), 'c': {c}}}" for c in children]
    return f"list_min([{', '.join(draws)}]).c"


def _placed(shards: int, name: str) -> str:
    nodes = tree(shards, REGIONS, RACKS)
    racks = " ".join(f"WHEN {r} THEN {_draw('rack', sorted(own))}" for r, own in nodes.items())
    leaves = " ".join(f"WHEN {k} THEN {_draw('shard', own)}" for of in nodes.values() for k, own in of.items())
    return f"""
{name}_r AS (SELECT *, {_draw('region', sorted(nodes))} AS region FROM d),
{name}_k AS (SELECT *, CASE region {racks} END AS rack FROM {name}_r),
{name} AS (SELECT doc_id, CASE rack {leaves} END AS shard FROM {name}_k)"""


def sharding_sql(shards: int = 40, buckets: int = 64) -> str:
    """CRC-32 is folded byte by byte with a table made from its polynomial."""
    return f"""
WITH t AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
b AS (SELECT doc_id, coalesce(text, '') AS text, CAST(doc_id AS VARCHAR) AS k, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS bytes FROM documents),
d AS (SELECT doc_id, k, len(bytes) + 16 AS size,
  xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32 FROM b, t),
{_placed(shards, 'now')}, {_placed(shards + 1, 'grown')},
p AS (SELECT d.*, now.shard::INTEGER AS shard, grown.shard::INTEGER AS grown_shard, CAST('0x' || substr(md5('slot:' || k || ':' || text_crc32), 1, 8) AS BIGINT) % {buckets} AS bucket
  FROM d JOIN now USING (doc_id) JOIN grown USING (doc_id))
SELECT doc_id, size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id) - 1 AS slot, grown_shard FROM p
"""


def suffix_sql(length: int = 50) -> str:
    return f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT doc_id, h, len(h) // 2 AS n FROM d),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, {2 * length}) AS s FROM (SELECT doc_id, h, unnest(range(0, n - {length - 1})) AS i FROM n)),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s),
r AS (SELECT w.doc_id, i, lag(i) OVER (PARTITION BY w.doc_id ORDER BY i) AS before FROM w JOIN f USING (s) WHERE first < w.doc_id),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR i > before + {length} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM r),
x AS (SELECT doc_id, run, min(i) AS a, max(i) + {length} AS b FROM g GROUP BY ALL),
y AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY run), 0) AS last FROM x),
z AS (SELECT doc_id, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed, max(b) AS b, string_agg(substr(h, 2 * last + 1, 2 * (a - last)), '' ORDER BY run) AS head FROM y JOIN n USING (doc_id) GROUP BY doc_id)
SELECT n.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(b, 0) + 1))) AS kept_sha256
FROM n LEFT JOIN z ON z.doc_id = n.doc_id
"""


QUALITY = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, source AS host, {WORDS} AS w FROM documents),
l AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \\t-\\r]')) AS ls FROM t),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM t)),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM again) GROUP BY doc_id),
c AS (SELECT l.doc_id, host, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars, len(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words FROM l LEFT JOIN rep ON rep.doc_id = l.doc_id),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c),
r AS (SELECT *, base_failed OR 2 * n_symbols > n_words OR 2 * n_dup_lines > n_lines AS rule_failed FROM b),
h AS (SELECT host, count(*)::DOUBLE AS n, count(*) FILTER (WHERE rule_failed)::DOUBLE AS f FROM r GROUP BY host),
m AS (SELECT sum(n) AS n, sum(f) AS f, count(*)::DOUBLE AS h, sum(f) / sum(n) AS mean, sum(f * f / n) / sum(n) - (sum(f) / sum(n)) * (sum(f) / sum(n)) AS between_ FROM h),
e AS (SELECT *, mean * (1 - mean) AS chance, between_ - mean * (1 - mean) * h / n AS excess, (f + 0.5) / (n + 1) AS centre FROM m),
k AS (SELECT centre, CASE WHEN excess > 0 THEN least(greatest((chance - between_) / excess, 1), 1e6) ELSE 1e6 END AS strength FROM e),
j AS (SELECT host, (f + centre * strength) / (h.n + strength) > 0.5 AS rejected FROM h, k)
SELECT doc_id, n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept
FROM r JOIN j ON r.host IS NOT DISTINCT FROM j.host
"""


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

LINES = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i, ls[i] AS line, translate(trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS k
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
g AS (SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
x AS (SELECT doc_id, count(*) AS n_dropped, list(i) AS gone FROM l JOIN g USING (k) WHERE doc_id <> keeper GROUP BY doc_id)
SELECT d.doc_id, len(ls) AS n_lines, coalesce(n_dropped, 0) AS n_dropped,
  sha256(CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_filter(ls, lambda s, i: NOT list_contains(gone, i)), chr(10)) END) AS kept_sha256
FROM d LEFT JOIN x USING (doc_id)
"""

_TERMS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

LEXICAL = f"""
WITH q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
d AS (SELECT doc_id, terms, len(terms) AS n FROM (SELECT doc_id, {_TERMS} AS terms FROM documents) WHERE len(terms) > 0),
s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS l FROM d),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM p, s GROUP BY term, docs),
i AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // l))) AS impact FROM p JOIN f USING (term), s),
r AS (SELECT item_id, doc_id, CAST(sum(impact) AS BIGINT) AS score FROM q JOIN i USING (term) GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0) WHERE rank <= 10
"""

#: CRC-32 is folded byte by byte; near words share a string with one letter gone, or masked at the same place.
SPELLING = f"""
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
o AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents) GROUP BY ALL),
h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(doc_id || ':' || run)), '..'), lambda b: CAST('0x' || b AS BIGINT))),
  lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM o, t WHERE length(run) >= 7),
c AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::INTEGER) || substr(run, (h % length(run))::INTEGER + 2) ELSE run END AS word, n FROM h),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM c WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
e AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
cut AS (SELECT DISTINCT word, left(word, i - 1) || substr(word, i + 1) AS less FROM e),
mask AS (SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM e),
ins AS (SELECT cut.word AS a, w.word AS b FROM cut JOIN w ON w.word = cut.less),
p AS (SELECT a, b FROM ins UNION SELECT b, a FROM ins UNION SELECT x.word, y.word FROM mask x JOIN mask y ON x.rest = y.rest AND x.i = y.i AND x.word <> y.word),
b AS (SELECT a, count(*) AS n_near, min({{'less': -w.n, 'near': b}}) AS best FROM p JOIN w ON w.word = b GROUP BY a),
f AS (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= 10 * n THEN best.near END AS form, CASE WHEN -best.less >= 10 * n THEN -best.less END AS form_n FROM w LEFT JOIN b ON b.a = w.word),
up AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT up.word, f.word, f.form FROM up JOIN f ON f.word = up.next)
SELECT f.word, form, up.root, n, n_near, CAST(form_n AS BIGINT) AS form_n FROM f JOIN up ON up.word = f.word AND up.next IS NULL
"""
