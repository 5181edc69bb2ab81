"""DuckDB SQL for the registered queries of this subpackage."""

from .url_filters import SUFFIXES

ORACLES: dict[str, str] = {}

ORACLES["op9_minhash_near_dedup"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) = 1 THEN [words[1]]
    ELSE list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) END) AS shingle
  FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), ranked AS (
  SELECT doc_id, shingle, row_number() OVER (PARTITION BY s.doc_id ORDER BY hash(shingle)) AS r FROM s
), near AS (
  SELECT DISTINCT a.doc_id AS a, b.doc_id AS b
  FROM ranked a JOIN ranked b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  WHERE a.r <= na.n - (4 * na.n + 4) // 5 + 1 AND b.r <= nb.n - (4 * nb.n + 4) // 5 + 1
    AND 5 * least(na.n, nb.n) >= 4 * greatest(na.n, nb.n)
), common AS (
  SELECT near.a, near.b, count(*) AS both_n
  FROM near JOIN s x ON x.doc_id = near.a JOIN s y ON y.doc_id = near.b AND y.shingle = x.shingle
  GROUP BY near.a, near.b
), link AS (
  SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 100 * both_n >= 80 * (na.n + nb.n - both_n)
), e AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach AS (
  SELECT a AS node, b AS other FROM e
  UNION
  SELECT reach.node, e.b FROM reach JOIN e ON e.a = reach.other
), low AS (SELECT node, min(other) AS other FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(low.other, d.doc_id)) AS component_id,
  d.doc_id = least(d.doc_id, coalesce(low.other, d.doc_id)) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN low ON low.node = d.doc_id
"""

ORACLES["op5_benchmark_decontamination"] = r"""
WITH i AS (
  SELECT item_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), p AS (
  SELECT DISTINCT item_id, size, unnest(list_transform(range(1, len(words) - size + 2), lambda k: array_to_string(words[k:k + size - 1], ' '))) AS win
  FROM (SELECT *, least(13, len(words)) AS size FROM i WHERE len(words) > 0)
), d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words
  FROM documents
), sizes AS (SELECT DISTINCT size FROM p
), m AS (
  SELECT doc_id, size, k, array_to_string(words[k:k + size - 1], ' ') AS win
  FROM (SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS k FROM d, sizes)
), h AS (SELECT m.doc_id, m.k, m.size, p.item_id FROM m JOIN p ON p.win = m.win AND p.size = m.size
), hit AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS w FROM h) GROUP BY doc_id
), it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.words) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""

ORACLES["op8_quality_rules"] = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), g AS (
  SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, win) AS times
  FROM (SELECT doc_id, unnest(range(1, len(words) - 3)) AS k, array_to_string(words[k:k + 4], ' ') AS win FROM w)
), r AS (SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(range(k, k + 5)) AS x FROM g WHERE times > 1) GROUP BY doc_id
), m AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, len(lines) AS n_lines,
    length(text) - length(replace(text, '!', '')) AS n_exclaims, coalesce(r.n, 0) AS n_repeat_words
  FROM w LEFT JOIN r USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR n_symbols * 5 > n_words OR n_dup_lines * 2 > n_lines
    OR (n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words)) OR n_exclaims * 4 > n_words) AS kept,
  CAST((n_words < 10)::INT + 2 * (100 * n_repeat_words > 20 * n_words)::INT + 4 * (n_symbols * 5 > n_words)::INT + 8 * (n_dup_lines * 2 > n_lines)::INT
    + 16 * (n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words))::INT + 32 * (n_exclaims * 4 > n_words)::INT AS BIGINT) AS failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS kept_v1
FROM m
"""

ORACLES["op1_line_dedup"] = r"""
WITH l AS (
  SELECT doc_id, source, unnest(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x09-\x0D ]')))) AS line
  FROM documents
), w AS (
  SELECT line FROM l GROUP BY line HAVING count(DISTINCT source) >= CASE WHEN length(line) < 20 THEN 10 ELSE 5 END
), o AS (SELECT l.* FROM l JOIN w USING (line)
), f AS (
  SELECT min(struct_pack(doc_id := doc_id, source := source)) AS first
  FROM documents WHERE doc_id IN (SELECT doc_id FROM o) GROUP BY text
), p AS (
  SELECT DISTINCT doc_id, piece
  FROM (
    SELECT doc_id, unnest(list_transform(string_split_regex(line, '[\n.,;:!?。、，！？]+'), lambda x: trim(x, ' '))) AS piece
    FROM l WHERE doc_id IN (SELECT first.doc_id FROM f) AND line NOT IN (SELECT line FROM w)
  ) WHERE piece <> ''
), own AS (SELECT piece, min(doc_id) AS owner FROM p GROUP BY piece
), ok AS (
  SELECT p.doc_id FROM p JOIN own USING (piece) GROUP BY p.doc_id
  HAVING 4 * sum(CASE WHEN owner = p.doc_id THEN length(piece) ELSE 0 END) >= 3 * sum(length(piece))
), h AS (SELECT o.doc_id, o.line, md5(o.line) AS h FROM o JOIN f ON f.first.doc_id = o.doc_id
), m AS (SELECT x.doc_id, x.line, min(y.h) AS mate FROM h x LEFT JOIN h y ON y.doc_id = x.doc_id AND y.line <> x.line GROUP BY ALL
), alone AS (SELECT line FROM (SELECT line, mate, count(*) AS n FROM m GROUP BY ALL) GROUP BY line HAVING 2 * coalesce(max(n) FILTER (mate IS NOT NULL), 0) < sum(n)
), b AS (
  SELECT line FROM o JOIN f ON f.first.doc_id = o.doc_id AND f.first.source = o.source
  WHERE o.doc_id IN (FROM ok) OR line IN (FROM alone) GROUP BY line
  HAVING count(DISTINCT o.source) >= CASE WHEN length(line) < 20 THEN 10 ELSE 5 END
), q AS (
  SELECT doc_id, i, lines[i] AS line
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))
), j AS (
  SELECT doc_id, string_agg(q.line, chr(10) ORDER BY i) FILTER (b.line IS NULL) AS text, count(b.line) AS n_removed
  FROM q LEFT JOIN b ON b.line = q.line GROUP BY doc_id
)
SELECT doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(j.text, '') END AS text, coalesce(n_removed, 0) AS n_removed
FROM documents d LEFT JOIN j USING (doc_id)
"""

ORACLES["op3_url_filters"] = r"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), q AS (
  SELECT *, string_split(plain, '.') AS parts, regexp_matches(plain, '^\[.*\]$|^[0-9]{1,3}(\.[0-9]{1,3}){3}$') AS ip
  FROM (SELECT *, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '\.$', '') AS plain FROM p)
), r AS (
  SELECT * EXCLUDE (parts, two, wide, ip), CASE WHEN ip THEN plain WHEN wide THEN array_to_string(parts[-3:], '.') ELSE two END AS domain, CASE WHEN ip THEN 'ip' WHEN wide THEN two ELSE parts[-1] END AS suffix
  FROM (SELECT *, two IN (SUFFIXES) AS wide FROM (SELECT *, array_to_string(parts[-2:], '.') AS two FROM q))
), o AS (
  SELECT host, domain, suffix, quality AS good FROM r
  JOIN labels ON labels.doc_id = try_cast(regexp_extract(path, '([0-9]{1,18})[^0-9]*$', 1) AS BIGINT)
  WHERE host <> '' AND quality IS NOT NULL
), h AS (SELECT host, domain, suffix, count(*)::DOUBLE AS n, sum(good)::DOUBLE AS good FROM o GROUP BY ALL
), ds AS (
  SELECT suffix, domain, sum(n) AS n, sum(good) AS good, count(*) AS j, sum(n * n) AS n2, sum(good * good / n) AS s2 FROM h GROUP BY ALL
), d AS (
  SELECT suffix, domain, n, good, least(0.5, greatest(0.01, coalesce((s2 - good * good / n - good / n * (1 - good / n) * (j - 1)) / nullif(good / n * (1 - good / n) * (n - n2 / n - (j - 1)), 0), 0.5))) AS x FROM ds
), ss AS (
  SELECT suffix, sum(n) AS n, sum(good) AS good, count(*) AS j, sum(n * n) AS n2, sum(good * good / n) AS s2 FROM d GROUP BY ALL
), s AS (
  SELECT suffix, n, good, least(0.5, greatest(0.01, coalesce((s2 - good * good / n - good / n * (1 - good / n) * (j - 1)) / nullif(good / n * (1 - good / n) * (n - n2 / n - (j - 1)), 0), 0.5))) AS x FROM ss
), ts AS (
  SELECT sum(n) AS n, sum(good) AS good, count(*) AS j, sum(n * n) AS n2, sum(good * good / n) AS s2 FROM s
), t AS (
  SELECT coalesce(n, 0) AS n, coalesce(good, 0) AS good, least(0.5, greatest(0.01, coalesce((s2 - good * good / n - good / n * (1 - good / n) * (j - 1)) / nullif(good / n * (1 - good / n) * (n - n2 / n - (j - 1)), 0), 0.5))) AS x,
    coalesce(good, 0) + 1.0 AS a, coalesce(n, 0) - coalesce(good, 0) + 1.0 AS b FROM ts
), sp AS (
  SELECT suffix, s.x, s.good + (1 - t.x) / t.x * t.a / (t.a + t.b) AS a, s.n - s.good + (1 - t.x) / t.x * t.b / (t.a + t.b) AS b FROM s, t
), dp AS (
  SELECT domain, d.x, d.good + (1 - sp.x) / sp.x * sp.a / (sp.a + sp.b) AS a, d.n - d.good + (1 - sp.x) / sp.x * sp.b / (sp.a + sp.b) AS b FROM d JOIN sp USING (suffix)
), hp AS (
  SELECT host, h.good + (1 - dp.x) / dp.x * dp.a / (dp.a + dp.b) AS a, h.n - h.good + (1 - dp.x) / dp.x * dp.b / (dp.a + dp.b) AS b FROM h JOIN dp USING (domain)
), ab AS (
  SELECT r.*, coalesce(hp.a, dp.a, sp.a, t.a) AS a, coalesce(hp.b, dp.b, sp.b, t.b) AS b
  FROM r LEFT JOIN hp USING (host) LEFT JOIN dp ON dp.domain = r.domain LEFT JOIN sp ON sp.suffix = r.suffix, t
), rules(rule, rh, rp, rv) AS (
  VALUES ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'), ('net/de/', 'net', '/de/', 'allow'), ('example.net/de/8', 'example.net', '/de/8', 'block'), ('org/es/', 'org', '/es/', 'block')
), fit AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(rv, length(rule)) AS rv
  FROM p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(rv, CASE WHEN a / (a + b) + 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) < 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM ab LEFT JOIN fit USING (page_id)
""".replace("SUFFIXES", ", ".join(f"'{s}'" for s in SUFFIXES))

ORACLES["op6_chat_perspectives"] = r"""
WITH t AS (
  SELECT DISTINCT conv_id, coalesce(turn, 0) AS turn, regexp_replace(regexp_replace(coalesce(role, 'unknown'), '[\x00-\x1F\x7F]+', ' ', 'g'), '<\|(im_start|im_end)\|>', '<| \1 |>', 'g') AS speaker,
    regexp_replace(coalesce(text, ''), '<\|(im_start|im_end)\|>', '<| \1 |>', 'g') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'
), x AS (
  SELECT conv_id, perspective, CAST(floor(turn / 512) AS BIGINT) AS segment, turn, speaker, text,
    '<|im_start|>' || CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user name=' || speaker END || chr(10) AS head,
    text || '<|im_end|>' AS body, CASE WHEN speaker = perspective THEN 1 ELSE 0 END AS own
  FROM t JOIN p USING (conv_id)
)
SELECT conv_id, perspective, segment, CAST(count(*) AS INTEGER) AS n_turns, string_agg(head || body || chr(10), '' ORDER BY turn, speaker, text) AS dialogue,
  string_agg(length(head) || ':0,' || length(body) || ':' || own || ',1:0', ',' ORDER BY turn, speaker, text) AS mask
FROM x GROUP BY conv_id, perspective, segment
"""

ORACLES["op12_filter_interactions"] = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS bad FROM labels GROUP BY doc_id
), first AS (SELECT text, min(doc_id) AS least FROM t GROUP BY text
), b AS (
  SELECT part, CASE WHEN len(words) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
      || CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 3 * length(text) THEN 'C' ELSE '' END
      || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN coalesce(t.doc_id > least, false) THEN 'E' ELSE '' END AS fails,
    coalesce(good, false) AS good, coalesce(bad, false) AS bad
  FROM t LEFT JOIN l USING (doc_id) JOIN first USING (text)
), f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), s AS (SELECT filter_order, step, filter_order[step] AS filter, filter_order[1:step - 1] AS behind FROM o, (SELECT unnest(range(1, 6)) AS step)
), g AS (SELECT part, fails, good, bad, count(*) AS n FROM b GROUP BY ALL
), x AS (
  SELECT part, filter_order, step, filter, n, good, bad, fails, contains(fails, filter) AS hit, len(regexp_extract_all(fails, '[' || behind || '_]')) > 0 AS gone FROM g, s
), y AS (
  SELECT part, filter_order, step, filter, coalesce(sum(n) FILTER (NOT gone AND NOT hit), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND hit), 0) AS removed,
    coalesce(sum(n) FILTER (gone AND hit), 0) AS redundant, coalesce(sum(n) FILTER (fails = filter), 0) AS unique_fails,
    coalesce(sum(n) FILTER (NOT gone AND hit AND good), 0) AS good_lost, coalesce(sum(n) FILTER (NOT gone AND hit AND bad), 0) AS toxic_lost
  FROM x GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM y
"""
