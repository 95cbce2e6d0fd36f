"""DuckDB SQL for the queries of training-data operators that SQL can express: written plainly, without the operators' methods."""

from __future__ import annotations

import math

from pulselake.llm.licenses import BLOCK, MARKS, PHRASES, SHORT, TEMPLATES, THRESHOLD
from pulselake.llm.url_filter import HOST_RULES, PATTERN_RULES

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPLIT = r"list_filter(regexp_split_to_array(coalesce({}, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"


def _components(nodes: str, links: str) -> str:
    """CTEs comp (node, c): the least node that each reaches over links (a, b), both ways. Labels spread until none falls."""
    return f"""both_ways AS (SELECT a, b FROM {links} UNION SELECT b, a FROM {links}),
reach AS (SELECT DISTINCT a AS node, a AS c FROM both_ways UNION SELECT w.b, r.c FROM reach r JOIN both_ways w ON r.node = w.a),
comp AS (SELECT n.node, coalesce(min(r.c), n.node) AS c FROM {nodes} n LEFT JOIN reach r ON n.node = r.node GROUP BY n.node)"""


OP3 = f"""WITH RECURSIVE w AS (SELECT doc_id, {_SPLIT.format(_LOWER.format("text"))} AS w FROM documents),
p AS (SELECT doc_id, w, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [1] ELSE range(1, len(w) - 3) END) AS i FROM w),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS g FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
nodes AS (SELECT doc_id AS node FROM documents),
{_components("nodes", "links")}
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, comp.c AS component_id FROM documents d JOIN comp ON comp.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""

# CRC-32 byte by byte: c becomes table[(c xor byte) and 255] xor (c >> 8); the table's entry is eight halvings of its number.
_HALVED = "n"
for _ in range(8):
    _HALVED = f"(SELECT xor(h >> 1, CASE WHEN h & 1 = 1 THEN 3988292384 ELSE 0 END) FROM (SELECT {_HALVED} AS h))"
OP4 = f"""WITH t AS (SELECT list(v ORDER BY n) AS t FROM (SELECT n, {_HALVED} AS v FROM range(0, 256) AS r(n))),
d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size, list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT))) AS b FROM documents),
c AS (SELECT doc_id, CAST(size AS BIGINT) AS size, xor(list_reduce(b, lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) AS text_crc32 FROM d, t),
o AS (SELECT *, sum(size) OVER w AS upto, sum(size) OVER () AS everything, row_number() OVER w AS g FROM c WINDOW w AS (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, CAST(least(23, ((2 * upto - size) * 24) // (2 * everything)) AS INTEGER) AS shard FROM o)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, g - min(g) OVER (PARTITION BY shard) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s"""

_USABLE = "WITH RECURSIVE v AS (SELECT vec_id, CASE WHEN embedding IS NULL OR len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) > 0 THEN NULL ELSE list_transform(embedding, lambda x: CAST(x AS DOUBLE)) END AS x FROM embeddings)"
OP5 = f"""{_USABLE},
u AS (SELECT vec_id, x, sqrt(list_inner_product(x, x)) AS n FROM v WHERE x IS NOT NULL AND list_inner_product(x, x) > 0),
links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM u p JOIN u q ON p.vec_id < q.vec_id AND len(p.x) = len(q.x) WHERE list_inner_product(p.x, q.x) / (p.n * q.n) >= 0.95),
nodes AS (SELECT vec_id AS node FROM v),
{_components("nodes", "links")},
k AS (SELECT node, count(*) AS k FROM (SELECT a AS node FROM both_ways) GROUP BY 1)
SELECT comp.node AS vec_id, coalesce(k, 0) AS n_links, c AS component_id, comp.node = c AS kept FROM comp LEFT JOIN k ON k.node = comp.node"""

OP6 = r"""WITH z AS (SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS BIGINT) AS size FROM documents),
p AS (SELECT source, sum(size) AS ss, count(*) AS n FROM z GROUP BY 1),
w AS (SELECT *, [1.0, 2.0, 3.0][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w, 3 * CAST(ss AS DOUBLE) AS cap FROM p),
l AS (SELECT *, (sum(CAST(ss AS DOUBLE)) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) / sum(w) OVER (ORDER BY cap / w, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v FROM w),
t AS (SELECT source, ss, n, least(cap, max(v) OVER () * w) AS target FROM l),
j AS (SELECT doc_id, z.source, size, ss, target, coalesce(target / nullif(CAST(ss AS DOUBLE), 0), 0.0) AS r, md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h, CAST(ceil(n / 512.0) AS BIGINT) AS g FROM z JOIN t ON z.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % g AS b FROM j),
m AS (SELECT *, sum(size) OVER (PARTITION BY source, b ORDER BY substr(h, 9), doc_id, size ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER (PARTITION BY source, b) AS total FROM k)
SELECT doc_id, size, CAST(ss AS BIGINT) AS source_size, target, CAST(size * (floor(r) + CASE WHEN 2 * upto - size < 2.0 * (r - floor(r)) * total THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM m"""

OP7 = f"""{_USABLE}, q AS (SELECT vec_id, list_transform(x, lambda y: floor(256 * y)) AS q FROM v WHERE x IS NOT NULL AND len(x) > 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM q a JOIN q b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5"""


def _op9() -> str:
    """Host rules by equality and endings of the host, free patterns by their expressions; host rules outrank, then longer names."""
    rules = []
    for r in HOST_RULES:
        h, path = r.name.split("/", 1)
        rules.append(f"SELECT page_id, 1 AS base, '{r.name}' AS name, '{r.verdict}' AS verdict FROM u WHERE (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{path}')")
    rules += [f"SELECT page_id, 0, '{r.name}', '{r.verdict}' FROM u WHERE regexp_matches(host || path, '{r.pattern}')" for r in PATTERN_RULES]
    return rf"""WITH s AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM s),
f AS ({" UNION ALL ".join(rules)}), b AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY base DESC, length(name) DESC, name DESC) AS o FROM f)
SELECT u.page_id, host, path, CASE WHEN base = 1 THEN name END AS rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN b ON u.page_id = b.page_id AND o = 1"""


def _op8() -> str:
    """Every template against every block: words in common, and words that must stand; phrases by their words' places."""

    def strings(ws) -> str:
        return "[" + ", ".join(f"'{w}'" for w in ws) + "]::VARCHAR[]"

    rows = []
    for label, text in TEMPLATES:
        ws = list(dict.fromkeys(text.split()))
        telling = [w for w in ws if w in MARKS]
        need = len(ws) if len(ws) < SHORT and not telling else math.ceil(THRESHOLD * len(ws) - 1e-9)
        rows.append(f"('{label}', {strings(ws)}, {need}, {strings(telling)}, {max(BLOCK, 2 * len(text.split()))})")
    places = " UNION ALL ".join(f"SELECT doc_id, '{label}' AS label, unnest(list_filter(range(1, len(w) + 1), lambda i: " + " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(p.split())) + ")) - 1 AS pos FROM w" for p, label in PHRASES)
    return rf"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
t AS (SELECT * FROM (VALUES {", ".join(rows)}) AS v(label, ws, need, telling, len)),
a AS ({places}), b AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS n, CAST(min(pos) AS BIGINT) AS lo, CAST(max(pos) AS BIGINT) AS hi FROM a GROUP BY 1),
k AS (SELECT doc_id, l.len, w[i + 1:i + l.len] AS b FROM w, (SELECT DISTINCT len FROM t) l, unnest(range(0, len(w), l.len // 2)) AS r(i)),
h AS (SELECT doc_id, label, len(list_intersect(b, ws)) / CAST(len(ws) AS DOUBLE) AS s FROM k JOIN t ON k.len = t.len WHERE len(list_intersect(b, ws)) >= need AND list_has_all(b, telling)),
bl AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS l FROM a GROUP BY 1), al AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS l FROM (SELECT doc_id, label FROM a UNION SELECT doc_id, label FROM h) GROUP BY 1), hs AS (SELECT doc_id, max(s) AS s FROM h GROUP BY 1)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(b.n, 0) AS n_base, lo AS first_word, hi AS last_word, coalesce(bl.l, '') AS base_labels, coalesce(al.l, '') AS labels, CASE WHEN b.n > 0 THEN 1.0 ELSE coalesce(hs.s, 0.0) END::DOUBLE AS score
FROM w LEFT JOIN b ON b.doc_id = w.doc_id LEFT JOIN bl ON bl.doc_id = w.doc_id LEFT JOIN al ON al.doc_id = w.doc_id LEFT JOIN hs ON hs.doc_id = w.doc_id"""


OP10 = f"""WITH t AS (SELECT doc_id, {_SPLIT.format("text")} AS words FROM documents), p AS (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM t WHERE len(words) >= 35),
h AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 34], ' ')) AS digest FROM p), again AS (SELECT digest FROM h GROUP BY 1 HAVING count(*) > 1),
gone AS (SELECT DISTINCT h.doc_id, unnest(range(h.i, h.i + 35)) AS place FROM h JOIN again ON h.digest = again.digest),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1), x AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM t),
k AS (SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.place) AS kept FROM x LEFT JOIN gone ON gone.doc_id = x.doc_id AND gone.place = x.place WHERE gone.doc_id IS NULL GROUP BY 1)
SELECT t.doc_id, CAST(len(t.words) AS BIGINT) AS n_words, coalesce(n.n, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM t LEFT JOIN n ON n.doc_id = t.doc_id LEFT JOIN k ON k.doc_id = t.doc_id"""

OP11 = rf"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p), n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY 1),
g AS (SELECT lang, m, unnest(list_transform(range(1, CAST(len(w) - m + 2 AS BIGINT)), lambda i: w[i:i + m - 1])) AS ws FROM w, (VALUES (1), (2), (3)) v(m) WHERE len(w) >= m),
f AS (SELECT lang, m, ws, count(*) AS f FROM g GROUP BY ALL), c AS (SELECT lang, m, ws, f AS a FROM f WHERE m > 1 AND f >= 10),
k AS (SELECT c.*, k, x.f AS l, y.f AS r, CAST((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS BIGINT) AS score FROM (SELECT *, unnest(range(1, m)) AS k FROM c) c
  JOIN f x ON x.lang = c.lang AND x.ws = c.ws[1:k] JOIN f y ON y.lang = c.lang AND y.ws = c.ws[k + 1:]),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, ws ORDER BY score, k) AS o FROM k),
h AS (SELECT lang, unnest([ws[1:2], ws[2:3]]) AS ws, a FROM c WHERE m = 3), i AS (SELECT lang, ws, max(a) AS longer FROM h GROUP BY 1, 2),
s AS (SELECT b.lang, array_to_string(b.ws, ' ') AS phrase, a, l, r, score FROM b LEFT JOIN i ON i.lang = b.lang AND i.ws = b.ws WHERE o = 1 AND 100 * coalesce(longer, 0) < 50 * a),
t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM s)
SELECT t.lang, rank, phrase, a, l, r, n, score FROM t JOIN n ON n.lang = t.lang WHERE rank <= 2000"""

_LETTERS = "(VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16))"
OP13 = rf"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, {_SPLIT.format("text")} AS w FROM documents), e AS (SELECT text, min(doc_id) AS least FROM d GROUP BY 1),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS bad FROM labels GROUP BY 1),
x AS (SELECT part, CAST(len(w) < 50 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 65 * len(w) AS INT) + 4 * CAST(100 * length(regexp_replace(d.text, '[^A-Z]', '', 'g')) > 5 * length(d.text) AS INT) + 8 * CAST(regexp_matches(d.text, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(least < d.doc_id, false) AS INT) AS mask,
  coalesce(good, 0) AS good, coalesce(bad, 0) AS bad FROM d JOIN e ON e.text = d.text LEFT JOIN l ON l.doc_id = d.doc_id),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.m, b.m, c.m, d.m, e.m] AS ms FROM {_LETTERS} a(x, m), {_LETTERS} b(x, m), {_LETTERS} c(x, m), {_LETTERS} d(x, m), {_LETTERS} e(x, m) WHERE a.m | b.m | c.m | d.m | e.m = 31),
s AS (SELECT filter_order, step, ms[step] AS own, CAST(coalesce(list_sum(ms[1:step - 1]), 0) AS INT) AS before FROM o, (VALUES (1), (2), (3), (4), (5)) v(step)),
p AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM x GROUP BY 1, 2),
r AS (SELECT part, filter_order, step, own, sum(CASE WHEN mask & (before | own) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN mask & own > 0 AND mask & before > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost,
  sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN bad ELSE 0 END) AS toxic_lost FROM p, s GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, {", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))}, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r"""

ORACLES = {"op3_ngram_join": OP3, "op4_sharding": OP4, "op5_embedding_dedup": OP5, "op6_mixing": OP6, "op7_topk": OP7, "op8_licenses": _op8(), "op9_url_filter": _op9(), "op10_substring_dedup": OP10, "op11_collocations": OP11, "op13_filter_audit": OP13}
