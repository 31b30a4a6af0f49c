"""DuckDB SQL for the queries of operators 3, 5, 7, 8 and 12: what the contracts
say, counted plainly over whole tables. Equal strings are named by their MD5."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SUFFIX_DEDUP = """
WITH d AS (SELECT doc_id, hex(coalesce(text, '')) AS x, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes FROM documents),
cut AS (SELECT doc_id, n_bytes, s, substr(x, CAST(2 * s * 1000 + 1 AS BIGINT), 2198) AS piece
        FROM d, unnest(range(0, (n_bytes + 999) // 1000)) AS u(s)),
win AS (SELECT doc_id, s * 1000 + i AS pos, md5_number(substr(piece, 2 * i + 1, 200)) AS h
        FROM cut, unnest(range(0, 1000)) AS u(i) WHERE s * 1000 + i + 100 <= n_bytes),
again AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY h ORDER BY doc_id, pos) AS k FROM win) WHERE k > 1),
jump AS (SELECT doc_id, pos, CASE WHEN pos <= lag(pos) OVER w + 100 THEN 0 ELSE 1 END AS fresh FROM again WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
numbered AS (SELECT doc_id, pos, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM jump),
span AS (SELECT doc_id, run, min(pos) AS lo, max(pos) + 100 AS hi FROM numbered GROUP BY doc_id, run),
edge AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS kept_from FROM span),
tot AS (SELECT doc_id, CAST(sum(hi - lo) AS BIGINT) AS n_removed, count(*) AS n_spans, max(hi) AS last_end FROM edge GROUP BY doc_id),
piece AS (SELECT e.doc_id, string_agg(substr(d.x, CAST(2 * kept_from + 1 AS BIGINT), CAST(2 * (lo - kept_from) AS BIGINT)), '' ORDER BY lo) AS front
          FROM edge e JOIN d USING (doc_id) GROUP BY e.doc_id)
SELECT d.doc_id, n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(front, '') || substr(x, CAST(2 * coalesce(last_end, 0) + 1 AS BIGINT)))) AS kept_sha256
FROM d LEFT JOIN tot USING (doc_id) LEFT JOIN piece USING (doc_id)"""

SUBSTRING_DEDUP = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, md5_number(array_to_string(list_slice(w, i, i + 34), ' ')) AS h
        FROM d, unnest(range(1, len(w) - 33)) AS u(i)),
again AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY h) > 1),
word AS (SELECT doc_id, i, w[i] AS word FROM d, unnest(range(1, len(w) + 1)) AS u(i)),
seen AS (SELECT word.doc_id, word.i, word, again.i IS NOT NULL AS starts FROM word LEFT JOIN again ON word.doc_id = again.doc_id AND word.i = again.i),
mark AS (SELECT doc_id, i, word, bool_or(starts) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM seen),
kept AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS t FROM mark GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""

JACCARD_JOIN = f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS} AS w FROM documents),
g AS (SELECT DISTINCT doc_id, md5_number(array_to_string(list_slice(w, i, i + 4), ' ')) AS h
      FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS u(i) WHERE len(w) > 0),
sets AS (SELECT doc_id, list(h ORDER BY h) AS hs, count(*) AS n FROM g GROUP BY doc_id),
class AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY hs) AS text_id FROM sets),
part AS (SELECT g.doc_id, n, h FROM g JOIN class USING (doc_id) WHERE doc_id = text_id),
link AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM part a JOIN part b ON a.h = b.h AND a.doc_id <> b.doc_id
         GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*))),
reach AS (SELECT a AS node, a AS root FROM link UNION SELECT link.b, reach.root FROM reach JOIN link ON link.a = reach.node),
root AS (SELECT node, min(root) AS root FROM reach GROUP BY node),
degree AS (SELECT a AS node, count(*) AS n_links FROM link GROUP BY a)
SELECT d.doc_id, coalesce(root, text_id, d.doc_id) AS class_id, coalesce(text_id, d.doc_id) AS text_id, coalesce(n_links, 0) AS n_links
FROM d LEFT JOIN class USING (doc_id) LEFT JOIN root ON root.node = text_id LEFT JOIN degree ON degree.node = text_id"""


RULES = f"""
WITH d AS (SELECT doc_id, lang, source, {WORDS} AS w, coalesce(text, '') AS t FROM documents),
five AS MATERIALIZED (SELECT doc_id, i, md5_number(array_to_string(list_slice(w, i, i + 4), ' ')) AS h FROM d, unnest(range(1, len(w) - 3)) AS u(i)),
win AS (SELECT doc_id, i FROM five JOIN (SELECT doc_id, h FROM five GROUP BY doc_id, h HAVING count(*) > 1) USING (doc_id, h)),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM win, unnest(range(0, 5)) AS u(k) GROUP BY doc_id),
line AS (SELECT doc_id, l FROM d, unnest(string_split(t, chr(10))) AS u(l) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]')),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines FROM line GROUP BY doc_id),
c AS MATERIALIZED (SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
             coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
      FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN lines USING (doc_id)),
m AS (SELECT doc_id, lang, source, n_words, m.measure, m.slack, m.mean, m.v FROM c, unnest([
        {{'measure': 'symbols', 'slack': 0.05::DOUBLE, 'mean': false, 'v': coalesce(n_symbols / nullif(n_words, 0), 0)}},
        {{'measure': 'dup_lines', 'slack': 0.1::DOUBLE, 'mean': false, 'v': coalesce(n_dup_lines / nullif(n_lines, 0), 0)}},
        {{'measure': 'repeats', 'slack': 0.05::DOUBLE, 'mean': false, 'v': coalesce(n_repeat_words / nullif(n_words, 0), 0)}},
        {{'measure': 'word_length', 'slack': 0.5::DOUBLE, 'mean': true, 'v': coalesce(word_chars / nullif(n_words, 0), 0)}}]) AS u(m)
      WHERE n_words > 0),
b AS (SELECT *, CASE WHEN v > 0 THEN pow(1.02::DOUBLE, ceil(ln(v) / ln(1.02::DOUBLE)) - 0.5) ELSE 0 END AS bin FROM m),
q AS (SELECT grouping_id(lang, source) AS level, lang, source, measure, any_value(slack) AS slack, count(*) AS n,
             list_sort(list(bin)) AS bins FROM b GROUP BY GROUPING SETS ((measure, lang, source), (measure, lang), (measure))),
quart AS (SELECT *, bins[CAST(ceil(n * 0.25) AS BIGINT)] AS lower, bins[CAST(ceil(n * 0.75) AS BIGINT)] AS upper FROM q),
mixed AS (SELECT o.lang, o.source, o.measure, o.slack, o.n / (o.n + 50) AS po, l.n / (l.n + 50) AS pl,
                 po * o.lower + (1 - po) * (pl * l.lower + (1 - pl) * a.lower) AS lower,
                 po * o.upper + (1 - po) * (pl * l.upper + (1 - pl) * a.upper) AS upper
          FROM quart o JOIN quart l ON o.level = 0 AND l.level = 1 AND o.measure = l.measure AND o.lang IS NOT DISTINCT FROM l.lang
          JOIN quart a ON a.level = 3 AND a.measure = o.measure),
far AS (SELECT m.doc_id, bool_or(m.v > x.upper + 4 * greatest(x.upper - x.lower, x.slack) * CASE WHEN m.mean THEN sqrt(1 + 20 / m.n_words) ELSE 1 END
                 OR (m.mean AND m.v < x.lower - 4 * greatest(x.upper - x.lower, x.slack) * sqrt(1 + 20 / m.n_words))) AS beyond
        FROM m JOIN mixed x ON m.measure = x.measure AND m.lang IS NOT DISTINCT FROM x.lang AND m.source IS NOT DISTINCT FROM x.source
        GROUP BY m.doc_id),
base AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(beyond, false) AS kept
FROM base LEFT JOIN far USING (doc_id)"""

PREFIX_TRIE = """
WITH id AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
crc AS (SELECT c, xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(z)::BIGINT FOR z IN string_split(c::VARCHAR, '')]),
          lambda s, z: list_reduce(list_prepend(xor(s, z), range(0, 8)),
            lambda r, k: xor(r >> 1, CASE WHEN r & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END))), 4294967295::BIGINT) % 9 AS h FROM id),
own AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS k,
               {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS t FROM conversations WHERE conv_id IS NOT NULL),
built AS (SELECT crc.c, k, t FROM crc JOIN own ON own.c = crc.c - crc.c % 5 AND k <= h
          UNION ALL SELECT crc.c, k, t FROM crc JOIN own ON own.c = crc.c AND k > h),
seq AS (SELECT id.c, coalesce(ts, []) AS ts FROM id LEFT JOIN (SELECT c, list(t ORDER BY k) AS ts FROM built GROUP BY c) USING (c)),
mem AS (SELECT c, len(ts) AS n, CAST(d AS BIGINT) AS depth, md5_number(to_json(list_slice(ts, 1, d))::VARCHAR) AS node,
               CASE WHEN d > 0 THEN md5_number(to_json(list_slice(ts, 1, d - 1))::VARCHAR) END AS parent,
               CASE WHEN d > 0 THEN strlen(ts[d].text) ELSE 0 END AS bytes
        FROM seq, unnest(range(0, len(ts) + 1)) AS u(d)),
node AS (SELECT node, any_value(parent) AS parent, any_value(depth) AS depth, min(c) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
                sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = depth), '')) AS ends_sha256 FROM mem GROUP BY node),
kids AS (SELECT parent AS node, count(*) AS n_children FROM node WHERE parent IS NOT NULL GROUP BY parent),
path AS (SELECT DISTINCT above.node AS top, below.node AS node FROM mem below JOIN mem above ON above.c = below.c AND above.depth <= below.depth),
sub AS (SELECT top AS node, count(*) FILTER (n_children IS NULL) AS n_leaves, CAST(sum((n_convs - 1) * bytes) AS BIGINT) AS saved_tokens
        FROM path JOIN node USING (node) LEFT JOIN kids USING (node) GROUP BY top)
SELECT node.conv_id, node.depth, up.conv_id AS parent_conv_id, node.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens,
       node.ends_sha256
FROM node LEFT JOIN node up ON up.node = node.parent LEFT JOIN kids ON kids.node = node.node JOIN sub ON sub.node = node.node"""
