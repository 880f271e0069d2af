"""SQL with the results of the registered queries, stated independently of how the operators compute them."""

from __future__ import annotations

from farol.llm.licenses import PHRASES, TEMPLATES
from farol.llm.url_filter import RULES, TERMS

ORACLES: dict[str, str] = {}


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"

# Every pair of documents with a shared shingle is counted; classes grow along the links until nothing changes.
ORACLES["op8_ngram_jaccard"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM words),
items AS (SELECT doc_id, unnest(s) AS g FROM sets),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM items a JOIN items b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM common JOIN sets a ON a.doc_id = x JOIN sets b ON b.doc_id = y
  WHERE 100 * n >= 85 * (len(a.s) + len(b.s) - n)),
both_ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (
  SELECT doc_id, doc_id AS other FROM sets
  UNION SELECT reach.doc_id, both_ways.y FROM reach JOIN both_ways ON reach.other = both_ways.x)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id
FROM sets JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1) USING (doc_id)
"""

# Bytes as hex text: every 50-byte string of every document, grouped; runs of removed bytes by gaps and islands.
ORACLES["op1_suffix_dedup"] = r"""
WITH bytes AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
sized AS (SELECT doc_id, h, CAST(length(h) // 2 AS BIGINT) AS n FROM bytes),
strings AS (
  SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(n - 49)) AS p FROM sized WHERE n >= 50)),
firsts AS (SELECT s, min(doc_id) AS first FROM strings GROUP BY s),
starts AS (SELECT doc_id, p FROM strings JOIN firsts USING (s) WHERE doc_id > first),
marked AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM starts),
islands AS (
  SELECT doc_id, p, sum(CASE WHEN before IS NULL OR p > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS island FROM marked),
spans AS (SELECT doc_id, island, min(p) AS low, max(p) + 50 AS high FROM islands GROUP BY 1, 2),
gaps AS (
  SELECT doc_id, low, substr(h, 2 * coalesce(lag(high) OVER w, 0) + 1, 2 * (low - coalesce(lag(high) OVER w, 0))) AS kept
  FROM spans JOIN sized USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY low)),
ends AS (SELECT doc_id, max(high) AS high, count(*) AS n_spans, sum(high - low) AS n_removed FROM spans GROUP BY 1),
joined AS (SELECT doc_id, string_agg(kept, '' ORDER BY low) AS kept FROM gaps GROUP BY 1)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(joined.kept, '') || substr(h, 2 * coalesce(high, 0) + 1))) AS kept_sha256
FROM sized LEFT JOIN ends USING (doc_id) LEFT JOIN joined USING (doc_id)
"""

# Every window of words that starts at a word of a notice is held against that notice, every word number against every phrase.
_NOTICES = ", ".join(f"('{label}', {_list(sorted(set(notice.split())))})" for label, notice in TEMPLATES)
_PHRASES = ", ".join(f"('{label}', {_list(phrase.split())})" for phrase, label in PHRASES.items())
ORACLES["op5_license_scan"] = rf"""
WITH notices(label, words) AS (VALUES {_NOTICES}),
phrases(label, words) AS (VALUES {_PHRASES}),
lowered AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
listed AS (
  SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM lowered),
places AS (
  SELECT doc_id, label, i - 1 AS place FROM (
    SELECT doc_id, label, words, w, unnest(range(1, len(w) + 1)) AS i FROM listed, phrases WHERE list_has_all(w, words))
  WHERE w[i:i + len(words) - 1] = words),
base AS (
  SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS labels FROM places GROUP BY 1),
numbered AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS spot FROM listed),
asked AS (SELECT row_number() OVER () AS notice, label, len(words) AS n, (len(words) * 100) // 80 AS longest, words FROM notices),
held AS (
  SELECT doc_id, notice, label, n, longest, spot, word FROM numbered JOIN (SELECT notice, label, n, longest, unnest(words) AS word FROM asked) USING (word)),
hits AS (
  SELECT a.doc_id, a.label, CAST(count(DISTINCT b.word) AS DOUBLE) / a.n AS containment
  FROM held a JOIN held b ON a.doc_id = b.doc_id AND a.notice = b.notice AND b.spot >= a.spot AND b.spot < a.spot + a.longest
  GROUP BY a.doc_id, a.notice, a.label, a.n, a.spot HAVING 100 * count(DISTINCT b.word) >= 80 * a.n),
more AS (SELECT doc_id, list(DISTINCT label) AS labels, max(containment) AS best FROM hits GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, first_word, last_word,
  coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0)::DOUBLE END AS score
FROM listed LEFT JOIN base USING (doc_id) LEFT JOIN more USING (doc_id)
"""

# Sources are filled one after another in the order of limit per weight; running sums over whole queues.
ORACLES["op6_weighted_fair_mix"] = r"""
WITH sized AS (
  SELECT doc_id, source, md5(CAST(doc_id AS VARCHAR)) AS turn,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS number FROM sized GROUP BY source),
weighed AS (SELECT *, [3, 1, 2][(number - 1) % 3 + 1] AS weight, sum(source_size) OVER () AS everything FROM sources),
filled AS (
  SELECT *, 3 * everything - 2 * coalesce(sum(2 * source_size) OVER others, 0) AS rest,
    sum(weight) OVER () - coalesce(sum(weight) OVER others, 0) AS open
  FROM weighed WINDOW others AS (ORDER BY 2 * source_size / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
marked AS (SELECT *, 4 * source_size * open <= weight * rest AS is_full FROM filled),
split AS (SELECT rest, open FROM marked WHERE NOT is_full ORDER BY 2 * source_size / weight, number LIMIT 1),
goals AS (
  SELECT source, source_size, CASE WHEN is_full THEN CAST(2 * source_size AS DOUBLE)
    ELSE weight * (SELECT rest FROM split)::DOUBLE / (2 * (SELECT open FROM split)::DOUBLE) END AS target FROM marked),
queued AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY turn, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before FROM sized)
SELECT doc_id, size, source_size, target, CAST(
  greatest(0, least(size, floor(target) - before)) + greatest(0, least(size, floor(target) - source_size - before)) AS BIGINT) AS taken
FROM queued JOIN goals ON queued.source IS NOT DISTINCT FROM goals.source
"""

# Rules as a table, the longest that fits; listed hosts by plain search.
_RULES = ", ".join(f"('{kind}', '{host}', '{path}')" for kind, host, path in RULES)
ORACLES["op10_url_filter"] = f"""
WITH rules(kind, rule_host, rule_path) AS (VALUES {_RULES}),
rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
fits AS (
  SELECT page_id, kind, rule_host || rule_path AS rule, row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC) AS n
  FROM parts JOIN rules ON (host = rule_host OR suffix(host, '.' || rule_host)) AND prefix(path, rule_path))
SELECT parts.page_id, host, path, rule, coalesce(kind, CASE WHEN regexp_matches(host, '{"|".join(TERMS)}') THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN fits ON parts.page_id = fits.page_id AND n = 1
"""

# Turns in order as one text per conversation; the template and its escapes by string functions.
ORACLES["op3_chat_tree"] = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
shown AS (
  SELECT *, '<turn role="' || replace(replace(replace(role, '\', '\\'), '<', '\l'), '"', '\q') || '">' || chr(10)
    || replace(replace(text, '\', '\\'), '<', '\l') || '</turn>' || chr(10) AS chat FROM rows)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum(length(chat)) AS BIGINT) AS formatted_chars
FROM shown GROUP BY conv_id
"""

# Captures as in page_captures; each revisit takes the last of all earlier responses of its url.
ORACLES["op9_revisits"] = r"""
WITH bare AS (
  SELECT *, regexp_replace(regexp_replace(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '') AS u FROM pages),
split AS (SELECT *, regexp_extract(u, '^[^?]*') AS place, regexp_extract(u, '^[^?]*\?(.*)$', 1) AS query FROM bare),
sorted AS (
  SELECT *, list_sort(list_filter(string_split(query, '&'), lambda p: p <> '' AND NOT starts_with(p, 'utm_')
    AND NOT list_contains(['ref', 'fbclid', 'gclid'], split_part(p, '=', 1)))) AS kept FROM split),
keyed AS (
  SELECT page_id, html, regexp_replace(lower(regexp_extract(place, '^[^/]*')), '^www[.]', '') || regexp_replace(regexp_extract(place, '^[^/]*(.*)$', 1), '/+$', '')
    || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS url_key FROM sorted),
captured AS (
  SELECT page_id, url_key, html, page_id % 3 = 2 AS revisit,
    CASE WHEN page_id % 5 <> 0 THEN '"' || substr(md5(url_key || '/' || CAST(page_id // 4000 AS VARCHAR)), 1, 8) || '"' END AS tag,
    CASE WHEN page_id % 2 = 0 THEN 'W/' ELSE '' END AS weak,
    CASE WHEN page_id % 7 <> 0 THEN strftime(make_timestamp((1600000000 + (page_id // 4000) * 86400) * 1000000), '%Y-%m-%d') END AS modified,
    strftime(make_timestamp((1600000000 + page_id * 3600) * 1000000), '%Y-%m-%d %H:%M:%S') AS date FROM keyed),
paired AS (
  SELECT r.*, f.page_id AS refers_to, f.tag AS full_tag, f.weak AS full_weak, f.modified AS full_modified, f.html AS full_html
  FROM captured r LEFT JOIN captured f ON r.url_key = f.url_key AND NOT f.revisit AND f.page_id < r.page_id WHERE r.revisit
  QUALIFY row_number() OVER (PARTITION BY r.page_id ORDER BY f.page_id DESC) = 1),
judged AS (
  SELECT *, CASE WHEN refers_to IS NULL THEN 'missing' WHEN tag IS NOT NULL THEN CASE WHEN tag = coalesce(full_tag, '') THEN 'resolved' ELSE 'changed' END
    WHEN modified IS NOT NULL THEN CASE WHEN modified IS NOT DISTINCT FROM full_modified THEN 'resolved' ELSE 'changed' END ELSE 'unchecked' END AS outcome FROM paired)
SELECT page_id AS record_id, url_key, refers_to, outcome, CASE WHEN outcome IN ('resolved', 'unchecked') THEN
    'content-length: ' || CAST(length(full_html) AS VARCHAR) || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || date
    || CASE WHEN tag IS NOT NULL THEN chr(10) || 'etag: ' || weak || tag WHEN full_tag IS NOT NULL THEN chr(10) || 'etag: ' || full_weak || full_tag ELSE '' END
    || coalesce(chr(10) || 'last-modified: ' || coalesce(modified, full_modified), '') END AS headers,
  CASE WHEN outcome IN ('resolved', 'unchecked') THEN sha256(full_html) END AS payload_sha256
FROM judged
"""

# Every document is scored for every item that shares a term with it.
ORACLES["op11_ranked_search"] = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
sizes AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
totals AS (SELECT count(*) AS holding, CAST(sum(n) AS BIGINT) AS total FROM sizes),
counts AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * holding + 2) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM counts GROUP BY term), totals),
scores AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * holding) // total)))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN counts USING (term) JOIN sizes USING (doc_id), totals GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 10
"""

ORACLES["op12_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
