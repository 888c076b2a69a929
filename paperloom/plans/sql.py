"""DuckDB SQL of the queries, for checking results."""

from __future__ import annotations

from itertools import accumulate
from math import log, pi, sqrt

from paperloom import lexicon as lx
from paperloom.functions.stats import TERMS
from paperloom.operators.metadata import CONFUSED, ISSUE, MONTH, QUARTER, VOLUME

NL = "chr(10)"
#: Accented letters count as word characters in Spark's patterns; here they are made a letter first.
_ASCII = "regexp_replace({}, '[À-ÖØ-öø-ÿ]', 'x', 'g')"
_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_Q = lambda pattern: pattern.replace("'", "''")

PANEL = "panel AS (SELECT paragraph_id, max(file_name) AS file_name, max(canonical_year) AS year, max(canonical_month) AS month, max(paragraph_text) AS text FROM paragraph_panel WHERE paragraph_id IS NOT NULL GROUP BY 1)"
_NORM = r"trim(regexp_replace(replace(replace(lower(coalesce(text, '')), chr(173), ''), '’', ''''), '[\s\x{00A0}]+', ' ', 'g'))"
_HITS = ", ".join(f"array_to_string(list_sort(list_distinct(regexp_extract_all(x, '{_Q(p)}', 1))), '|') AS {k}_hits" for k, p in lx.ALL_PATTERNS.items())
LABELS = f"{PANEL}, normed AS (SELECT *, {_ASCII.format(_NORM)} AS x FROM panel), labels AS (SELECT *, {_HITS} FROM normed)"
_COMBINED = f"{lx.COMBINED}_hits"
_THEME = {t: f"{t}_hits <> ''" for t in lx.THEMES} | {
    "theme_anti_discrimination": f"contains({_COMBINED}, 'discriminat')",
    "theme_equal_opportunity": f"(contains({_COMBINED}, 'equal opportunity') OR contains({_COMBINED}, 'equal employment opportunity') OR contains({_COMBINED}, 'equal access'))",
}
_YM = "coalesce(year::VARCHAR, '') || '-' || CASE WHEN month IS NULL THEN '00' ELSE lpad(month::VARCHAR, 2, '0') END"
GROUPED = f"""{LABELS}, themed AS (SELECT *, {_YM} AS year_month FROM labels),
grouped AS (SELECT 'panethnic_appeared' AS group_name, * FROM themed WHERE panethnic_hits <> '' UNION ALL SELECT 'ethnic_appeared', * FROM themed WHERE ethnic_hits <> '')"""


def _long(by: str) -> str:
    """Counts by group, further columns and theme."""
    parts = [f"SELECT group_name{by}, '{t}' AS theme, count(*) AS n_paragraphs, count(*) FILTER (WHERE {c}) AS n_theme FROM grouped GROUP BY ALL" for t, c in _THEME.items()]
    return " UNION ALL ".join(parts)


def rounded(query: str, columns: str) -> str:
    return f"SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in columns.split())}) FROM ({query})"


_PRETTY = "array_to_string(list_transform(string_split(replace(regexp_replace(theme, '^(policy_frame_|domain_|theme_)', ''), '_', ' '), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"
_PREV = f"WITH {GROUPED}, long AS ({_long('')}) SELECT group_name, theme, {_PRETTY} AS theme_pretty, n_paragraphs AS n_paragraphs_group, n_theme, 100.0 * n_theme / n_paragraphs AS pct_theme FROM long"
_S = list(accumulate(log(2 * j + 1) for j in range(1, TERMS + 1)))
_ERF = f"CASE WHEN z = 0 THEN 0 WHEN z > 6 THEN 1 ELSE {2 / sqrt(pi)!r} * exp(-z * z) * z * (1 + list_sum(list_transform(range(1, {TERMS + 1}), lambda k: exp(k * ln(2 * z * z) - ([{', '.join(map(repr, _S))}])[k])))) END"
_CONTRAST = f"""WITH prev AS ({_PREV}), wide AS (
  SELECT theme, coalesce(max(CASE WHEN group_name = 'panethnic_appeared' THEN n_theme END), 0) AS x1, coalesce(max(CASE WHEN group_name = 'panethnic_appeared' THEN n_paragraphs_group END), 0) AS n1,
    coalesce(max(CASE WHEN group_name = 'ethnic_appeared' THEN n_theme END), 0) AS x2, coalesce(max(CASE WHEN group_name = 'ethnic_appeared' THEN n_paragraphs_group END), 0) AS n2 FROM prev GROUP BY 1),
o AS (SELECT *, ((x1 + 0.5::DOUBLE) / (n1 - x1 + 0.5::DOUBLE)) / ((x2 + 0.5::DOUBLE) / (n2 - x2 + 0.5::DOUBLE)) AS odds, (x1 + x2)::DOUBLE / (n1 + n2) AS p FROM wide),
zs AS (SELECT *, abs(x1::DOUBLE / n1 - x2::DOUBLE / n2) / nullif(sqrt(p * (1 - p) * (1.0::DOUBLE / n1 + 1.0::DOUBLE / n2)), 0) / {sqrt(2)!r} AS z FROM o)
SELECT theme, n1 AS n_panethnic_paragraphs, n2 AS n_ethnic_paragraphs, x1 AS n_theme_panethnic, x2 AS n_theme_ethnic, 100.0 * x1 / n1 AS pct_panethnic, 100.0 * x2 / n2 AS pct_ethnic,
  100.0 * x1 / n1 - 100.0 * x2 / n2 AS gap_pct_pan_minus_eth, odds AS odds_ratio_pan_vs_eth, ln(odds) AS log_odds_ratio_pan_vs_eth,
  coalesce(greatest(0, least(1, 1 - ({_ERF}))), 1) AS p_value_two_prop_z FROM zs"""
_MONTHLY = f"{GROUPED}, long AS ({_long(', year_month')}), monthly AS (SELECT year_month, group_name, theme, n_paragraphs, n_theme, 100.0 * n_theme / n_paragraphs AS per100 FROM long)"
_GRID = f"""{_MONTHLY}, grid AS (SELECT m.year_month, g.group_name, t.theme, coalesce(per100, 0.0) AS per100 FROM (SELECT DISTINCT year_month FROM monthly) m
  CROSS JOIN (SELECT unnest(['panethnic_appeared', 'ethnic_appeared']) AS group_name) g CROSS JOIN (SELECT unnest({_LIST(lx.THEMES)}) AS theme) t LEFT JOIN monthly USING (year_month, group_name, theme))"""
_GAPS = f"""{_GRID}, wide AS (SELECT theme, year_month, sum(CASE WHEN group_name = 'panethnic_appeared' THEN per100 ELSE 0 END) AS pan, sum(CASE WHEN group_name = 'ethnic_appeared' THEN per100 ELSE 0 END) AS eth FROM grid GROUP BY 1, 2),
gaps AS (SELECT *, pan - eth AS gap, CASE WHEN pan > eth THEN eth END AS low, CASE WHEN pan > eth THEN pan END AS high FROM wide)"""

_T = "coalesce(text, '')"
_LET = lambda t: f"length(regexp_replace({t}, '[^\\p{{L}}]', '', 'g'))"
_TOK = rf"regexp_extract_all({_T}, '[^\s\x{{00A0}}]+')"
_METRICS = rf"""SELECT paragraph_id, length({_T}) AS n_chars, len({_TOK}) AS n_tokens,
  len(regexp_extract_all({_ASCII.format(_T).replace("'x'", "'1'")}, '\b[a-zA-Z][a-zA-Z''-]*\b')) AS n_word_tokens,
  coalesce({_LET(_T)}::DOUBLE / nullif(length({_T}), 0), 0) AS alpha_ratio, coalesce(length(regexp_replace({_T}, '[^\p{{Nd}}]', '', 'g'))::DOUBLE / nullif(length({_T}), 0), 0) AS digit_ratio,
  coalesce(greatest(0, length({_T}) - {_LET(_T)} - length(regexp_replace({_T}, '[^\p{{Nd}}]', '', 'g')) - length(regexp_replace({_T}, '[^\s\x{{00A0}}]', '', 'g')))::DOUBLE / nullif(length({_T}), 0), 0) AS punct_ratio,
  coalesce(len(list_filter(list_filter({_TOK}, lambda w: regexp_matches(w, '[A-Za-z]')), lambda w: NOT regexp_matches(w, '[aeiouAEIOU]')))::DOUBLE / nullif(len(list_filter({_TOK}, lambda w: regexp_matches(w, '[A-Za-z]'))), 0), 0) AS nonvowel_token_ratio
  FROM panel"""
_SIGNAL = " OR ".join(f"{k}_hits <> ''" for k in ["panethnic", "ethnic", "policy_frame_funding", *lx.DOMAINS, "theme_invisibility"])
GATE = f"""{LABELS}, metrics AS ({_METRICS}), reasons AS (
  SELECT l.*, m.* EXCLUDE (paragraph_id), array_to_string(list_filter([CASE WHEN n_tokens < 8 THEN 'too_few_tokens' END, CASE WHEN n_word_tokens < 5 THEN 'too_few_word_tokens' END, CASE WHEN alpha_ratio < 0.55 THEN 'low_alpha_ratio' END,
  CASE WHEN punct_ratio > 0.22 THEN 'high_punct_ratio' END, CASE WHEN nonvowel_token_ratio > 0.45 THEN 'high_nonvowel_token_ratio' END], lambda r: r IS NOT NULL), '|') AS reasons FROM labels l JOIN metrics m USING (paragraph_id)),
gate AS (SELECT *, reasons <> '' AND ({_SIGNAL}) AND n_word_tokens >= 5 AND alpha_ratio >= 0.45 AS rescued FROM reasons),
gated AS (SELECT *, (rescued OR reasons = '')::INTEGER AS quality_keep, CASE WHEN rescued THEN 'rescued_substantive_signal' WHEN reasons = '' THEN 'pass' ELSE reasons END AS quality_reason FROM gate)"""
_N = {"identity_labeled": "(panethnic_hits <> '' OR ethnic_hits <> '')", "panethnic_appeared": "panethnic_hits <> ''", "ethnic_appeared": "ethnic_hits <> ''", "both_labels": "panethnic_hits <> '' AND ethnic_hits <> ''", "invisibility": "theme_invisibility_hits <> ''", "funding": "policy_frame_funding_hits <> ''"}
ISSUES = f"""{GATE}, issue AS (SELECT file_name, max(year) AS year, max(month) AS month, count(*) AS n_paragraphs_raw, count(*) FILTER (WHERE quality_keep = 1) AS n_paragraphs_filtered,
  {', '.join(f'count(*) FILTER (WHERE quality_keep = 1 AND {c}) AS n_{k}' for k, c in _N.items())} FROM gated GROUP BY 1),
issues AS (SELECT *, coalesce(100.0 * n_paragraphs_filtered / nullif(n_paragraphs_raw, 0), 0.0) AS keep_rate_pct, {', '.join(f'coalesce(100.0 * n_{k} / nullif(n_paragraphs_filtered, 0), 0.0) AS {k}_pct' for k in _N)} FROM issue)"""
_F2 = lambda x: f"printf('%.2f', ({x})::DOUBLE)"
_CORPUS = {"n_issues": "count(*)", "paragraphs_raw_total": "sum(n_paragraphs_raw)", "paragraphs_filtered_total": "sum(n_paragraphs_filtered)", "keep_rate_pct_overall": "100.0 * sum(n_paragraphs_filtered) / sum(n_paragraphs_raw)"}
_CORPUS |= {f"{a}_paragraphs_per_issue_{f}": f"{g}(n_paragraphs_{a})" for a in ("raw", "filtered") for f, g in (("mean", "avg"), ("median", "median"), ("min", "min"), ("max", "max"))}
_CORPUS |= {f"{k}_total": f"sum(n_{k})" for k in _N} | {"identity_labeled_pct_of_filtered": "100.0 * sum(n_identity_labeled) / sum(n_paragraphs_filtered)"}

META = "meta AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY file_name ORDER BY loaded_at DESC NULLS LAST, validation_status DESC NULLS LAST) AS r FROM issue_metadata) WHERE r = 1)"
_FILE = {"file_year": r"try_cast(nullif(regexp_extract(file_name, '^(\d{4})_(\d{2})\.pdf$', 1), '') AS INTEGER)", "file_month": r"try_cast(nullif(regexp_extract(file_name, '^(\d{4})_(\d{2})\.pdf$', 2), '') AS INTEGER)"}
_ISO = lambda y, m: f"CASE WHEN {y} IS NOT NULL AND {m} IS NOT NULL THEN printf('%04d-%02d-01', {y}, {m}) END"
LINES = "latest AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY loaded_at DESC NULLS LAST, text DESC NULLS LAST) AS r FROM line_text WHERE line_id IS NOT NULL) WHERE r = 1)"
_CLEAN = "upper(coalesce(front_text, ''))"
for _old, _new in CONFUSED:
    _CLEAN = f"replace({_CLEAN}, '{_old}', '{_new}')"
_MAP = lambda word, pairs: "CASE " + word + " " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in pairs.items()) + " END"
FRONTS = rf"""{LINES}, fronts AS (SELECT file_name, string_agg(text, {NL} ORDER BY column_index, y0, x0, line_id) AS front_text FROM latest WHERE page_number = 1 AND text IS NOT NULL GROUP BY 1),
c AS (SELECT file_name, {_ASCII.format(_CLEAN).replace("'x'", "'Q'")} AS c FROM fronts),
mq AS (SELECT *, nullif(regexp_extract(c, '{MONTH}', 1), '') AS m, nullif(regexp_extract(c, '{QUARTER}', 1), '') AS q FROM c),
anchor AS (SELECT *, CASE WHEN m IS NOT NULL THEN length(string_split_regex(c, '{MONTH}')[1]) + 1 WHEN q IS NOT NULL THEN length(string_split_regex(c, '{QUARTER}')[1]) + 1 ELSE 0 END AS a FROM mq),
years AS (SELECT file_name, min_by(substr(c, i, 4)::INTEGER, (abs(i - a), i)) AS front_year FROM (SELECT *, unnest(range(1, length(c) - 2)) AS i FROM anchor) WHERE regexp_matches(substr(' ' || c || ' ', i, 6), '^\W(?:19|20)\d\d\W$') GROUP BY 1),
parsed AS (SELECT file_name, coalesce({_MAP('m', lx.MONTHS)}, {_MAP('q', lx.QUARTERS)}) AS front_month, front_year, nullif(regexp_extract(c, '{VOLUME}', 1), '') AS front_volume, nullif(regexp_extract(c, '{_Q(ISSUE)}', 1), '') AS front_issue_no,
  CASE WHEN q IS NOT NULL THEN q[1] || lower(q[2:]) || ' Quarter' END AS front_period_label,
  CASE WHEN m IS NOT NULL THEN CASE WHEN front_year IS NOT NULL THEN 'high' ELSE 'medium' END WHEN q IS NOT NULL AND front_year IS NOT NULL THEN 'medium' ELSE 'low' END AS front_confidence FROM anchor LEFT JOIN years USING (file_name))"""
_SOURCE = "CASE WHEN front_year IS NULL AND front_month IS NULL THEN 'filename' WHEN front_year IS NOT NULL AND front_month IS NOT NULL AND file_year IS NOT NULL AND file_month IS NOT NULL THEN CASE WHEN front_year = file_year AND front_month = file_month THEN 'both' ELSE 'conflict' END WHEN front_year IS NOT NULL AND file_year IS NOT NULL AND front_year <> file_year THEN 'conflict' ELSE 'filename_with_front_partial' END"
_STATUS = lambda s: f"CASE {s} WHEN 'both' THEN 'validated_match' WHEN 'conflict' THEN 'review_needed' WHEN 'filename_with_front_partial' THEN 'front_partial' ELSE 'front_missing' END"

SEGMENTS = f"""{LINES}, heights AS (SELECT *, median(greatest(1.0, y1 - y0)) OVER (PARTITION BY file_name, page_number, column_index) AS h FROM latest),
gapped AS (SELECT *, (y0 - lag(y1) OVER w > greatest(8.0, 1.25 * h))::INTEGER AS new FROM heights WHERE trim(text) <> '' WINDOW w AS (PARTITION BY file_name, page_number, column_index ORDER BY y0, x0, line_id)),
segments AS (SELECT *, (1 + sum(coalesce(new, 0)) OVER (PARTITION BY file_name, page_number, column_index ORDER BY y0, x0, line_id ROWS UNBOUNDED PRECEDING))::INTEGER AS paragraph_in_column FROM gapped),
paras AS (SELECT file_name, page_number, column_index, paragraph_in_column, string_agg(text, {NL} ORDER BY y0, x0, line_id) AS t, count(*) AS n FROM segments GROUP BY 1, 2, 3, 4),
pages AS (SELECT file_name, page_number, count(DISTINCT column_index) AS column_count, sum(n)::BIGINT AS line_count, string_agg(t, {NL} || {NL} ORDER BY column_index, paragraph_in_column) AS page_text FROM paras GROUP BY 1, 2)"""
_CENTERS = f"""{LINES}, cs AS (SELECT file_name, page_number, (x0 + x1) / 2 AS c, length(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) >= 20 AND y1 - y0 >= 6 AS good, length(coalesce(text, '')) >= 5 AS five FROM latest),
cn AS (SELECT *, count(*) FILTER (WHERE good) OVER p AS n1, count(*) FILTER (WHERE five) OVER p AS n2 FROM cs WINDOW p AS (PARTITION BY file_name, page_number)),
cand AS (SELECT * FROM cn WHERE CASE WHEN n1 >= 8 THEN good WHEN n2 > 0 THEN five ELSE true END),
stepped AS (SELECT *, count(*) OVER (PARTITION BY file_name, page_number) AS n, coalesce((c - lag(c) OVER (PARTITION BY file_name, page_number ORDER BY c) > 0.18 * 612)::INTEGER, 0) AS step FROM cand),
numbered AS (SELECT *, CASE WHEN n < 4 THEN 0 ELSE sum(step) OVER (PARTITION BY file_name, page_number ORDER BY c) END::INTEGER AS column_no FROM stepped),
centers AS (SELECT file_name, page_number, column_no, avg(c) AS center FROM numbered WHERE column_no < 3 GROUP BY 1, 2, 3)"""

_LOW = "replace(replace(lower(coalesce(text, '')), '’', ''''), chr(173), '')"
_BARE = "regexp_replace(regexp_replace(t, '^''+|''+$', '', 'g'), '''s$', '')"
_ALIAS = "CASE b " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in lx.ALIASES.items()) + " ELSE b END"
_CUT = "CASE WHEN a LIKE '%ies' THEN a[:-4] || 'y' WHEN a LIKE '%sses' THEN a[:-3] WHEN a LIKE '%s' AND a NOT LIKE '%ss' THEN a[:-2] END"
_GONE = _LIST([*lx.STOPWORDS, *lx.IDENTITY_TERMS, *lx.NOISE_TOKENS])
_POLICY = _LIST(lx.POLICY_TERMS)


def _tokens(of: str) -> str:
    """CTEs seq (paragraph_id, file_name, pan, eth, tokens) over the rows of `of`."""
    return f"""src AS (SELECT * FROM {of}), tok AS (SELECT paragraph_id, unnest(regexp_extract_all(low, '[a-z][a-z''-]+')) AS t, generate_subscripts(regexp_extract_all(low, '[a-z][a-z''-]+'), 1) AS i FROM (SELECT paragraph_id, {_LOW} AS low FROM src)),
bare AS (SELECT *, {_BARE} AS b FROM tok), aliased AS (SELECT *, {_ALIAS} AS a FROM bare), cut AS (SELECT *, {_CUT} AS s FROM aliased),
normal AS (SELECT paragraph_id, i, CASE WHEN list_contains({_POLICY}, b) THEN b WHEN list_contains({_POLICY}, a) THEN a WHEN length(a) >= 6 AND list_contains({_POLICY}, s) THEN s ELSE a END AS w FROM cut),
kept AS (SELECT paragraph_id, list(w ORDER BY i) AS tokens FROM normal WHERE length(w) >= 4 AND NOT list_contains({_GONE}, w) GROUP BY 1),
seq AS (SELECT src.*, coalesce(tokens, []) AS tokens FROM src LEFT JOIN kept USING (paragraph_id))"""


TERMSEQ = f"{LABELS}, flagged AS (SELECT paragraph_id, file_name, text, (panethnic_hits <> '')::INTEGER AS pan, (ethnic_hits <> '')::INTEGER AS eth FROM labels WHERE panethnic_hits <> '' OR ethnic_hits <> ''), {_tokens('flagged')}"
_GRAM = lambda n: f"SELECT paragraph_id, pan, eth, {n} AS n, unnest(list_transform(range(1, len(tokens) - {n - 2}), lambda i: tokens[i:i + {n - 1}])) AS g FROM seq WHERE len(tokens) >= {n}"
_KEYED = lambda lo, hi, name: (
    f"{name}_g AS ({' UNION ALL '.join(_GRAM(n) for n in range(lo, hi + 1))}), {name} AS (SELECT DISTINCT paragraph_id, pan, eth, n, n || '||' || array_to_string(CASE WHEN n = 2 THEN list_sort(g) ELSE g END, '|||') AS key FROM {name}_g WHERE list_has_any(g, {_POLICY}) AND NOT (n = 2 AND g[1] = g[2]))"
)
KEYS = f"{TERMSEQ}, {_KEYED(2, 4, 'keys')}, {_KEYED(1, 1, 'uni')}"
_DIRECT = "direct AS (SELECT g[1] AS a, g[2] AS b, count(*) AS n FROM keys_g WHERE n = 2 GROUP BY 1, 2)"
SCORED = f"""{KEYS}, supp AS (SELECT key, count(*) AS pooled_n, sum(pan)::BIGINT AS pan_n, sum(eth)::BIGINT AS eth_n, any_value(n)::INTEGER AS n FROM keys GROUP BY 1),
unis AS (SELECT key[4:] AS t, count(*) AS u FROM uni GROUP BY 1),
docs AS (SELECT count(*) AS pooled_docs, coalesce(sum(pan), 0)::BIGINT AS pan_docs, coalesce(sum(eth), 0)::BIGINT AS eth_docs FROM (SELECT paragraph_id, max(pan) AS pan, max(eth) AS eth FROM keys GROUP BY 1)),
top AS (SELECT * FROM supp WHERE greatest(pan_n, eth_n) >= 8),
parts AS (SELECT key, sum(ln(greatest(1e-12::DOUBLE, coalesce(u, 0)::DOUBLE / greatest(1, pooled_docs)))) AS ln_parts FROM (SELECT key, unnest(string_split(string_split(key, '||')[1 + 1] , '|||')) AS t FROM (SELECT replace(key, '|||', chr(1)) AS k2, key FROM top) ) x LEFT JOIN unis USING (t), docs GROUP BY 1),
pm AS (SELECT top.*, docs.*, ln(greatest(1e-12::DOUBLE, pooled_n::DOUBLE / greatest(1, pooled_docs))) - ln_parts AS pmi FROM top JOIN parts USING (key), docs),
sc AS (SELECT *, pooled_n::DOUBLE * (1 + least(2.5::DOUBLE, greatest(0.0::DOUBLE, pmi))) * (1 + 0.22::DOUBLE * (n - 2)) AS score, pan_n::DOUBLE / greatest(1, pan_docs) - eth_n::DOUBLE / greatest(1, eth_docs) AS gap FROM pm),
scored AS (SELECT *, score * (1 + least(2.0::DOUBLE, 12 * abs(gap))) AS select_score FROM sc)"""
SCORED = SCORED.replace("SELECT key, unnest(string_split(string_split(key, '||')[1 + 1] , '|||')) AS t FROM (SELECT replace(key, '|||', chr(1)) AS k2, key FROM top) ", "SELECT key, unnest(string_split(key[4:], '|||')) AS t FROM top")
_SUBSET = lambda chosen: f"""words AS (SELECT key, n, pan_n + eth_n AS cnt, list_distinct(string_split(key[4:], '|||')) AS ws FROM {chosen} WHERE n >= 2),
best AS (SELECT k.key, min_by(c.key, (c.n, -c.cnt, c.key)) AS rep FROM words k JOIN words c ON c.n < k.n AND c.cnt >= greatest(3.0, 0.45 * k.cnt) AND len(list_filter(c.ws, lambda w: NOT list_contains(k.ws, w))) = 0 GROUP BY 1),
variant AS (SELECT s.key, coalesce(b2.rep, b1.rep, s.key) AS rep FROM {chosen} s LEFT JOIN best b1 ON b1.key = s.key LEFT JOIN best b2 ON b2.key = b1.rep)"""  # noqa: E731
CHOSEN = f"{SCORED}, chosen AS (SELECT * FROM scored ORDER BY round(select_score, 9) DESC, key LIMIT 90), {_SUBSET('chosen')}, recount AS (SELECT DISTINCT paragraph_id, pan, eth, rep AS key FROM keys JOIN variant USING (key))"
_IN = lambda w, ws: f"list_contains({_LIST(ws)}, {w})"
_NAMED = "CASE " + " ".join(f"WHEN list_sort(ws) = {_LIST(sorted(k.split()))} THEN '{v}'" for k, v in lx.LABELS.items()) + " END"
_CANON = "CASE nm " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in lx.CANONICAL.items()) + " ELSE nm END"
LABELLED = f"""{CHOSEN}, {_DIRECT}, rk AS (SELECT DISTINCT rep AS key, rep[1]::INTEGER AS n, string_split(rep[4:], '|||') AS ws FROM variant),
ro AS (SELECT rk.*, ws[1] AS a, ws[2] AS b, coalesce(x.n, 0) AS ab, coalesce(y.n, 0) AS ba FROM rk LEFT JOIN direct x ON x.a = ws[1] AND x.b = ws[2] LEFT JOIN direct y ON y.a = ws[2] AND y.b = ws[1]),
rn AS (SELECT *, CASE WHEN n <> 2 THEN array_to_string(ws, ' ') ELSE coalesce({_NAMED}, CASE WHEN {_IN('a', lx.MODIFIERS)} AND NOT {_IN('b', lx.MODIFIERS)} THEN a || ' ' || b WHEN {_IN('b', lx.MODIFIERS)} AND NOT {_IN('a', lx.MODIFIERS)} THEN b || ' ' || a
  WHEN {_IN('a', lx.HEADS)} AND NOT {_IN('b', lx.HEADS)} THEN b || ' ' || a WHEN {_IN('b', lx.HEADS)} AND NOT {_IN('a', lx.HEADS)} THEN a || ' ' || b WHEN ba > ab THEN b || ' ' || a ELSE a || ' ' || b END) END AS nm FROM ro),
lab AS (SELECT key, n, {_CANON} AS label FROM rn)"""
NODES = f"""{LABELLED}, cnts AS (SELECT key, sum(pan)::BIGINT AS pan_n, sum(eth)::BIGINT AS eth_n FROM recount GROUP BY 1 HAVING greatest(sum(pan), sum(eth)) >= 8),
nb AS (SELECT label AS node, string_agg(DISTINCT key, ';;' ORDER BY key) AS node_key, min(n) AS ngram_n, sum(pan_n)::BIGINT AS pan_n, sum(eth_n)::BIGINT AS eth_n FROM cnts JOIN lab USING (key) GROUP BY 1),
nr AS (SELECT nb.*, pan_n + eth_n AS pooled_n, pan_n::DOUBLE / greatest(1, pan_docs) AS pan_rate, eth_n::DOUBLE / greatest(1, eth_docs) AS eth_rate FROM nb, docs),
ng AS (SELECT *, pan_rate - eth_rate AS gap_pan_minus_eth FROM nr),
nodes AS (SELECT *, pooled_n * (1 + least(2.0::DOUBLE, 12 * abs(gap_pan_minus_eth))) AS selection_score, CASE WHEN gap_pan_minus_eth > 0.01 THEN 'panethnic_tilt' WHEN gap_pan_minus_eth < -0.01 THEN 'ethnic_tilt' ELSE 'shared' END AS tilt FROM ng),
pl AS (SELECT DISTINCT paragraph_id, label FROM recount JOIN lab USING (key) WHERE label IN (SELECT node FROM nodes)),
pairs AS (SELECT x.label AS from_node, y.label AS to_node, count(*) AS weight_n FROM pl x JOIN pl y ON x.paragraph_id = y.paragraph_id AND x.label < y.label GROUP BY 1, 2 HAVING count(*) >= 3),
picked AS (SELECT node, tilt, pooled_n FROM (SELECT *, (row_number() OVER (PARTITION BY tilt ORDER BY pooled_n DESC, round(abs(gap_pan_minus_eth), 9) DESC, node) <= 6)::INTEGER AS f FROM nodes) ORDER BY f DESC, round(pooled_n * (1 + 5 * abs(gap_pan_minus_eth)), 9) DESC, pooled_n DESC, node LIMIT 28)"""
_PAN = f"{LABELS}, flagged AS (SELECT paragraph_id, file_name, text, 1 AS pan, 0 AS eth FROM labels WHERE panethnic_hits <> ''), {_tokens('flagged')}"
PHRASE = SCORED.replace(TERMSEQ, _PAN) + f", chosen AS (SELECT * FROM scored ORDER BY round(score, 9) DESC, key LIMIT 70), {_SUBSET('chosen')}, recount AS (SELECT DISTINCT paragraph_id, rep AS key FROM keys JOIN variant USING (key))"

GRAPH = "ded AS (SELECT DISTINCT batch_no, file_name, from_node, to_node, weight_n FROM dual_hub_edges WHERE edge_type = 'term_term'), graph AS (SELECT least(from_node, to_node) AS a, greatest(from_node, to_node) AS b, sum(weight_n)::BIGINT AS w FROM ded WHERE from_node IS NOT NULL AND to_node IS NOT NULL AND weight_n IS NOT NULL GROUP BY 1, 2), weights AS (SELECT node, sum(w)::BIGINT AS weight FROM (SELECT a AS node, w FROM graph UNION ALL SELECT b, w FROM graph) GROUP BY 1)"
COMPONENTS = f"""{GRAPH}, strong AS (SELECT * FROM graph WHERE w >= 3), links AS (SELECT a, b FROM strong UNION SELECT b, a FROM strong),
walk AS (SELECT a AS node, a AS seen FROM links UNION SELECT walk.node, links.b FROM walk JOIN links ON links.a = walk.seen), comp AS (SELECT node, min(seen) AS component FROM walk GROUP BY 1),
sw AS (SELECT node, sum(w)::BIGINT AS weight FROM (SELECT a AS node, w FROM strong UNION ALL SELECT b, w FROM strong) GROUP BY 1),
cid AS (SELECT component, row_number() OVER (ORDER BY sum(weight) DESC, min(node))::INTEGER AS community_id FROM comp JOIN sw USING (node) GROUP BY 1),
ranked AS (SELECT node, community_id, row_number() OVER (PARTITION BY community_id ORDER BY weight DESC, node)::INTEGER AS community_rank, weight FROM comp JOIN sw USING (node) JOIN cid USING (component))"""

WORDS = f"{PANEL}, {_tokens('(SELECT paragraph_id, file_name, text FROM panel)')}"
_WORDROWS = f"{WORDS}, word AS (SELECT file_name, unnest(tokens) AS word FROM seq)"
_TFIDF = f"""{_WORDROWS}, wn AS (SELECT file_name, word, count(*) AS n FROM word GROUP BY 1, 2), tot AS (SELECT file_name, sum(n)::BIGINT AS total FROM wn GROUP BY 1), dfs AS (SELECT word, count(*) AS df FROM wn GROUP BY 1),
tfidf AS (SELECT file_name, word, n, total, n::DOUBLE / total * ln((SELECT count(*) FROM tot)::DOUBLE / df) AS tf_idf FROM wn JOIN tot USING (file_name) JOIN dfs USING (word))"""
_WIN = f"{WORDS}, win AS (SELECT list_distinct(w) AS w FROM (SELECT unnest(list_transform(range(1, len(tokens) - 2), lambda i: tokens[i:i + 3])) AS w FROM seq WHERE len(tokens) >= 4))"
_COS = "list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[])"
_KNN = lambda where, k: f"near AS (SELECT * FROM (SELECT q.vec_id AS query_id, v.vec_id, {_COS} AS similarity, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, v.vec_id)::INTEGER AS rank FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE {where}) WHERE rank <= {k})"


def queries() -> dict[str, str]:
    stop = "|".join(lx.FUNCTION_WORDS)
    return {
        "theme_contrast": rounded(_CONTRAST, "pct_panethnic pct_ethnic gap_pct_pan_minus_eth odds_ratio_pan_vs_eth log_odds_ratio_pan_vs_eth p_value_two_prop_z"),
        "theme_prevalence": rounded(_PREV, "pct_theme"),
        "identity_type": f"WITH {LABELS} SELECT paragraph_id, CASE WHEN panethnic_hits <> '' AND ethnic_hits <> '' THEN 'both' WHEN panethnic_hits <> '' THEN 'panethnic' WHEN ethnic_hits <> '' THEN 'ethnic' ELSE 'none' END AS identity_type, (NOT ({' OR '.join(f'{k}_hits' + ' <> ' + chr(39) * 2 for k in lx.DOMAINS)}))::INTEGER AS domain_other FROM labels",
        "pattern_hits": f"WITH {LABELS} " + " UNION ALL ".join(f"SELECT paragraph_id, '{k}' AS label, {k}_hits AS hits FROM labels WHERE {k}_hits <> ''" for k in lx.ALL_PATTERNS),
        "split_theme": f"WITH {LABELS} SELECT paragraph_id, ({_THEME['theme_anti_discrimination']})::INTEGER AS anti, ({_THEME['theme_equal_opportunity']})::INTEGER AS equal FROM labels WHERE {_COMBINED} <> ''",
        "monthly_theme": rounded(f"WITH {_MONTHLY} SELECT * FROM monthly", "per100"),
        "group_share_gap": rounded(f"WITH {LABELS}, v AS (SELECT {_YM} AS year_month, count(*) AS n, 100.0 * count(*) FILTER (WHERE panethnic_hits <> '') / count(*) AS pct_panethnic, 100.0 * count(*) FILTER (WHERE ethnic_hits <> '') / count(*) AS pct_ethnic FROM labels WHERE year IS NOT NULL AND month BETWEEN 1 AND 12 GROUP BY 1) SELECT *, pct_panethnic - pct_ethnic AS gap FROM v", "pct_panethnic pct_ethnic gap"),
        "complete_grid": rounded(f"WITH {_GRID} SELECT * FROM grid", "per100"),
        "normalize_max100": rounded(f"WITH {_GRID} SELECT year_month, group_name, theme, coalesce(100.0 * per100 / nullif(max(per100) OVER (PARTITION BY theme, group_name), 0), 0.0) AS norm FROM grid", "norm"),
        "gap_ribbon": rounded(f"WITH {_GAPS} SELECT * FROM gaps", "pan eth gap low high"),
        "gap_change": rounded(f"WITH {_GAPS} SELECT theme, min_by(gap, year_month) AS first_gap, max_by(gap, year_month) AS last_gap, max_by(gap, year_month) - min_by(gap, year_month) AS change, printf('%+.1f', max_by(gap, year_month) - min_by(gap, year_month)) AS label FROM gaps GROUP BY 1", "first_gap last_gap change"),
        "axis_breaks": f"WITH {_MONTHLY} SELECT year_month FROM (SELECT year_month, row_number() OVER (ORDER BY year_month) AS i FROM (SELECT DISTINCT year_month FROM monthly)) WHERE (i - 1) % 4 = 0",
        "key_themes": f"WITH {GROUPED}, long AS ({_long('')}) SELECT group_name, theme, n_theme AS n FROM long WHERE theme IN ('domain_education', 'domain_health', 'domain_housing', 'domain_immigration', 'domain_employment_labor', 'policy_frame_funding')",
        "table_prevalence": rounded(f"SELECT batch_no, group_name, theme, {_PRETTY} AS pretty, coalesce(100.0 * n_theme / greatest(n_paragraphs_group, 1), 0.0) AS pct FROM (SELECT DISTINCT * FROM paragraph_theme_prevalence_by_group)", "pct"),
        "text_metrics": rounded(f"WITH {PANEL} {_METRICS}", "alpha_ratio digit_ratio punct_ratio nonvowel_token_ratio"),
        "quality_filter": f"WITH {GATE} SELECT paragraph_id, quality_keep, quality_reason FROM gated",
        "quality_split": f"WITH {GATE} SELECT quality_reason, count(*) AS n, sum(quality_keep)::BIGINT AS n_kept FROM gated GROUP BY 1",
        "issue_summary": rounded(f"WITH {ISSUES} SELECT * FROM issues", "keep_rate_pct " + " ".join(f"{k}_pct" for k in _N)),
        "corpus_summary": f"WITH {ISSUES}, t AS (SELECT {', '.join(f'{_F2(c)} AS {k}' for k, c in _CORPUS.items())}, min(printf('%04d-%02d-01', year, month)) FILTER (WHERE year IS NOT NULL AND month IS NOT NULL) AS date_min, max(printf('%04d-%02d-01', year, month)) FILTER (WHERE year IS NOT NULL AND month IS NOT NULL) AS date_max FROM issues) " + " UNION ALL ".join(f"SELECT '{k}' AS metric, {k} AS value FROM t" for k in [*_CORPUS, 'date_min', 'date_max']),
        "key_union": "SELECT coalesce(a.file_name, b.file_name) AS file_name, coalesce(in_panel, 0) AS in_panel, coalesce(in_metadata, 0) AS in_metadata FROM (SELECT DISTINCT file_name, 1 AS in_panel FROM paragraph_panel) a FULL JOIN (SELECT DISTINCT file_name, 1 AS in_metadata FROM issue_metadata) b ON a.file_name = b.file_name",
        "issue_lookup": f"WITH {PANEL}, {META} SELECT paragraph_id, coalesce(canonical_issue_date, '') AS issue_date, coalesce(validation_status, '') AS status FROM panel LEFT JOIN meta USING (file_name)",
        "filename_date": f"SELECT *, {_ISO('file_year', 'file_month')} AS file_issue_date FROM (SELECT file_name, {', '.join(f'{v} AS {k}' for k, v in _FILE.items())} FROM (SELECT DISTINCT file_name FROM issue_metadata))",
        "front_parse": f"WITH {FRONTS} SELECT * FROM parsed",
        "resolve_date_source": f"WITH {FRONTS}, f AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in _FILE.items())} FROM parsed), s AS (SELECT *, {_SOURCE} AS date_source FROM f) SELECT file_name, date_source, date_source = 'conflict' AS date_conflict, {_STATUS('date_source')} AS validation_status, {_ISO('front_year', 'front_month')} AS front_issue_date, {_ISO('file_year', 'file_month')} AS canonical_issue_date FROM s",
        "date_conflicts": f"WITH {META} SELECT file_name, file_issue_date, front_year, front_month, validation_status FROM meta WHERE date_conflict",
        "parse_outcomes": f"WITH {META} SELECT date_source, count(*) AS n, count(*) FILTER (WHERE date_review_needed) AS n_review FROM meta GROUP BY 1",
        "table_date_source": f"WITH {META} SELECT file_name, derived, {_STATUS('derived')} AS derived_status FROM (SELECT file_name, {_SOURCE} AS derived FROM meta)",
        "best_parse": f"WITH {META}, p AS (SELECT *, (front_year IS NOT NULL)::INTEGER + (front_month IS NOT NULL)::INTEGER AS x, (file_year IS NOT NULL)::INTEGER + (file_month IS NOT NULL)::INTEGER AS y FROM meta) SELECT file_name, CASE WHEN y > x THEN file_year ELSE front_year END AS year, CASE WHEN y > x THEN file_month ELSE front_month END AS month FROM p",
        "gap_segmentation": f"WITH {SEGMENTS} SELECT line_id, paragraph_in_column FROM segments",
        "paragraph_sequence": rf"WITH {SEGMENTS} SELECT regexp_replace(file_name, '\.[^.]*$', '') || '_p' || page_number || '_c' || column_index || '_n' || paragraph_in_column AS paragraph_id, paragraph_in_column, row_number() OVER (PARTITION BY file_name, page_number ORDER BY column_index, paragraph_in_column)::INTEGER AS paragraph_in_page, t AS paragraph_text FROM paras WHERE length(regexp_replace(lower(t), '[^a-z0-9]', '', 'g')) >= 8",
        "page_text": f"WITH {SEGMENTS} SELECT * FROM pages",
        "issue_text": f"WITH {SEGMENTS} SELECT file_name, ((page_number - 1) // 1000)::INTEGER AS part, count(*) AS page_count, string_agg(page_text, {NL} || {NL} ORDER BY page_number) AS issue_text FROM pages GROUP BY 1, 2",
        "column_cluster": rounded(f"WITH {_CENTERS} SELECT * FROM centers", "center"),
        "nearest_column": f"WITH {_CENTERS}, b AS (SELECT line_id, min_by(column_no, (abs((x0 + x1) / 2 - center), column_no)) AS column_no FROM latest JOIN centers USING (file_name, page_number) GROUP BY 1) SELECT line_id, column_no FROM b",
        "line_debris": f"WITH {LINES} SELECT line_id, file_name FROM latest WHERE length(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]', '', 'g')) >= 2",
        "layout_clean": rf"WITH {LINES} SELECT line_id, regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(text, chr(173), ''), 'ﬁ', 'fi'), 'ﬂ', 'fl'), '’', ''''), '[ \t]+', ' ', 'g'), '\n{{3,}}', {NL} || {NL}, 'g'), '^\s+|\s+$', '', 'g') AS clean FROM latest WHERE text IS NOT NULL",
        "token_sequence": f"WITH {TERMSEQ} SELECT paragraph_id, array_to_string(tokens, ' ') AS tokens FROM seq",
        "ngram_df": f"WITH {SCORED} SELECT key, pooled_n, pan_n, eth_n, n FROM supp",
        "directional_bigram": f"WITH {KEYS}, {_DIRECT} SELECT * FROM direct",
        "doc_totals": f"WITH {SCORED} SELECT * FROM docs",
        "pmi_score": rounded(f"WITH {SCORED} SELECT key, n, pmi, score, gap, select_score FROM scored", "pmi score gap select_score"),
        "select_terms": f"WITH {CHOSEN} SELECT key, pooled_n FROM chosen",
        "merge_stats": f"WITH {CHOSEN} SELECT count(*) AS n_keys, count(*) FILTER (WHERE key <> rep) AS n_merged FROM variant",
        "variant_merge": f"WITH {CHOSEN} SELECT key, rep FROM variant",
        "rep_recount": f"WITH {CHOSEN} SELECT key, sum(pan)::BIGINT AS pan_n, sum(eth)::BIGINT AS eth_n FROM recount GROUP BY 1",
        "label_terms": f"WITH {LABELLED} SELECT key, n, label FROM lab",
        "dual_hub_nodes": rounded(f"WITH {NODES} SELECT * FROM nodes", "pan_rate eth_rate gap_pan_minus_eth selection_score"),
        "dual_hub_edges": rounded(f"WITH {NODES} SELECT 'panethnic_hub' AS from_node, node AS to_node, 'hub_term' AS edge_type, 'Panethnic Hub' AS edge_group, pan_n AS weight_n, pan_rate AS weight_rate FROM nodes UNION ALL SELECT 'ethnic_hub', node, 'hub_term', 'Ethnic Hub', eth_n, eth_rate FROM nodes UNION ALL (SELECT from_node, to_node, 'term_term', 'Term-Term', weight_n, NULL::DOUBLE FROM pairs ORDER BY weight_n DESC, from_node, to_node LIMIT 220)", "weight_rate"),
        "pair_counts": f"WITH {NODES} SELECT * FROM pairs",
        "choose_nodes": f"WITH {NODES} SELECT * FROM picked",
        "grouped_layout": rounded(f"WITH {NODES}, pi AS (SELECT *, row_number() OVER (PARTITION BY tilt ORDER BY pooled_n DESC, node) - 1 AS i, count(*) OVER (PARTITION BY tilt) AS n FROM picked) SELECT node, (CASE tilt WHEN 'panethnic_tilt' THEN -0.64 WHEN 'shared' THEN -0.02 ELSE 0.74 END + CASE WHEN n > 5 THEN 0.024 * ((i % 2) * 2 - 1) ELSE 0 END)::DOUBLE AS x, (CASE WHEN n = 1 THEN 1.7 ELSE 1.7 - 3.4::DOUBLE * i / (n - 1) END - 0.18)::DOUBLE AS y FROM pi", "x y"),
        "hub_word_stats": rounded(f"WITH {TERMSEQ}, w AS (SELECT word, sum(pan)::BIGINT AS pan_n, sum(eth)::BIGINT AS eth_n FROM (SELECT pan, eth, unnest(list_distinct(tokens)) AS word FROM seq) GROUP BY 1 HAVING greatest(sum(pan), sum(eth)) >= 8), t AS (SELECT sum(pan)::BIGINT AS p, sum(eth)::BIGINT AS e FROM seq) SELECT word, pan_n, eth_n, pan_n::DOUBLE / p AS pan_rate, eth_n::DOUBLE / e AS eth_rate, ln(((pan_n + 0.5::DOUBLE) * (e - eth_n + 0.5::DOUBLE)) / ((eth_n + 0.5::DOUBLE) * (p - pan_n + 0.5::DOUBLE))) AS log_odds_pan_vs_eth FROM w, t", "pan_rate eth_rate log_odds_pan_vs_eth"),
        "graph_edges": f"WITH {GRAPH} SELECT * FROM graph",
        "connected_components": f"WITH RECURSIVE {COMPONENTS} SELECT node, component FROM comp",
        "component_summary": f"WITH RECURSIVE {COMPONENTS} SELECT community_id, count(*) AS n_terms, sum(weight)::BIGINT AS total_weight, string_agg(node, ', ' ORDER BY community_rank) FILTER (WHERE community_rank <= 4) AS community_label, string_agg(node, '|' ORDER BY community_rank) FILTER (WHERE community_rank <= 8) AS top_terms FROM ranked GROUP BY 1 HAVING count(*) >= 2",
        "community_labels": f"WITH RECURSIVE {COMPONENTS} SELECT * FROM ranked WHERE community_rank <= 5",
        "edge_filter": f"WITH {GRAPH} SELECT * FROM graph WHERE a IN (SELECT node FROM weights WHERE weight >= 10) AND b IN (SELECT node FROM weights WHERE weight >= 10)",
        "drop_terms": f"WITH {GRAPH} SELECT * FROM graph WHERE a NOT IN ('budget', 'field office') AND b NOT IN ('budget', 'field office')",
        "hub_row": rounded(f"WITH {GRAPH} SELECT node, weight::DOUBLE AS weight FROM weights UNION ALL SELECT 'panethnic_hub', 1.35 * max(weight) FROM weights HAVING max(weight) IS NOT NULL", "weight"),
        "vertex_size": rounded(f"WITH {GRAPH}, r AS (SELECT min(weight) AS lo, max(weight) AS hi FROM weights) SELECT node, CASE WHEN hi <= lo THEN 12.0 ELSE 4.0 + 16.0 * pow((weight - lo)::DOUBLE / (hi - lo), 0.5) END AS size FROM weights, r", "size"),
        "edge_width": rounded("SELECT *, 0.4 + 2.6 * n / max(n) OVER (PARTITION BY hub) AS width FROM (SELECT hub, to_node, sum(cooccur_n)::BIGINT AS n FROM hub_word_edges WHERE cooccur_n IS NOT NULL GROUP BY 1, 2)", "width"),
        "fcm_window": f"""WITH {WORDS}, p AS (SELECT paragraph_id, unnest(tokens) AS w, generate_subscripts(tokens, 1) AS i FROM seq), often AS (SELECT w FROM p GROUP BY 1 HAVING count(*) >= 5)
SELECT least(x.w, y.w) AS a, greatest(x.w, y.w) AS b, count(*) AS n FROM p x JOIN p y ON x.paragraph_id = y.paragraph_id AND y.i - x.i BETWEEN 1 AND 6 AND x.w <> y.w
WHERE x.w IN (FROM often) AND y.w IN (FROM often) GROUP BY 1, 2""",
        "pairwise_pmi": rounded(f"WITH {_WIN}, s AS (SELECT a, count(*) AS n_a FROM (SELECT unnest(w) AS a FROM win) GROUP BY 1), wi AS (SELECT w, row_number() OVER () AS id FROM win), u AS (SELECT id, unnest(w) AS a FROM wi), p AS (SELECT x.a, y.a AS b, count(*) AS n FROM u x JOIN u y ON x.id = y.id AND x.a < y.a GROUP BY 1, 2) SELECT p.a, p.b, n, ln(n::DOUBLE * (SELECT count(*) FROM win) / (s.n_a::DOUBLE * t.n_a)) AS pmi FROM p JOIN s ON s.a = p.a JOIN s t ON t.a = p.b", "pmi"),
        "kwic": f"WITH {WORDS}, p AS (SELECT paragraph_id, tokens, unnest(tokens) AS w, generate_subscripts(tokens, 1) AS i FROM seq) SELECT paragraph_id, (i - 1)::INTEGER AS place, array_to_string(tokens[greatest(1, i - 6):i - 1], ' ') AS before, array_to_string(tokens[i + 1:i + 6], ' ') AS after FROM p WHERE w = 'grant'",
        "slide_windows": f"WITH {WORDS}, w AS (SELECT paragraph_id, tokens, unnest(range(1, len(tokens) - 2)) AS i FROM seq WHERE len(tokens) >= 4) SELECT paragraph_id, (i - 1)::INTEGER AS window_no, array_to_string(tokens[i:i + 3], ' ') AS words FROM w",
        "tf_idf": rounded(f"WITH {_TFIDF} SELECT * FROM tfidf", "tf_idf"),
        "track_keyword": rounded(f"WITH {_TFIDF} SELECT word, sum(n)::BIGINT AS n, sum(tf_idf) AS tf_idf FROM tfidf WHERE regexp_matches(word, '^immigra|^deport|^visa') GROUP BY 1", "tf_idf"),
        "top_terms": f"WITH {_WORDROWS}, wn AS (SELECT file_name, word, count(*) AS n FROM word GROUP BY 1, 2) SELECT * FROM (SELECT *, rank() OVER (PARTITION BY file_name ORDER BY n DESC)::INTEGER AS rank FROM wn) WHERE rank <= 10",
        "vocab_prune": f"WITH {_WORDROWS} SELECT word, count(*) AS n FROM word GROUP BY 1 HAVING count(*) >= 5",
        "clean_corpus": rf"SELECT doc_id, lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_ASCII.format('text').replace(chr(39) + 'x' + chr(39), chr(39) + '0' + chr(39))}, '\b(?:{stop})\b', '', 'g'), '[^a-zA-Z]+', ' ', 'g'), '\b[a-zA-Z]{{1,3}}\b', ' ', 'g'), ' +', ' ', 'g'))) AS clean FROM documents WHERE text IS NOT NULL AND text <> ''",
        "both_groups": f"WITH {TERMSEQ} SELECT word, sum(pan)::BIGINT AS pan_n, sum(eth)::BIGINT AS eth_n FROM (SELECT pan, eth, unnest(list_distinct(tokens)) AS word FROM seq) GROUP BY 1 HAVING sum(pan) > 0 AND sum(eth) > 0",
        "cosine_knn": rounded(f"WITH {_KNN('q.vec_id % 20 = 0', 10)} SELECT * FROM near", "similarity"),
        "knn_overlap": f"WITH {_KNN('q.vec_id % 20 = 0', 10)} SELECT (query_id // 40)::BIGINT AS pair, vec_id, CASE WHEN min(query_id) < max(query_id) THEN 'shared' WHEN min(query_id) % 40 = 0 THEN 'first only' ELSE 'second only' END AS class FROM near GROUP BY 1, 2",
        "analogy_knn": rounded("WITH e AS (SELECT embedding::DOUBLE[] AS v, vec_id FROM embeddings), t AS (SELECT list_transform(range(1, len(e1.v) + 1), lambda i: (e1.v[i]::FLOAT - e2.v[i]::FLOAT + e3.v[i]::FLOAT)::DOUBLE) AS t FROM e e1, e e2, e e3 WHERE e1.vec_id = 1 AND e2.vec_id = 2 AND e3.vec_id = 3) SELECT vec_id, list_cosine_similarity(v, t) AS similarity FROM e, t", "similarity"),
        "mean_similarity": rounded(f"WITH {_KNN('q.vec_id % 20 = 0', 50)} SELECT query_id, label, avg(similarity) AS mean_similarity FROM near JOIN embeddings USING (vec_id) GROUP BY 1, 2", "mean_similarity"),
        "confidence_band": rounded("""WITH u AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS k FROM embeddings), v AS (SELECT label, (k - 1)::INTEGER AS dim, avg(x) AS est, stddev_samp(x) AS sd, count(*) AS n FROM u GROUP BY 1, 2)
SELECT label, dim, est, est - 1.96 * sd / sqrt(n) AS low, est + 1.96 * sd / sqrt(n) AS high FROM v""", "est low high"),
        "nearest_vertex": rounded(f"WITH {NODES}, pi AS (SELECT *, row_number() OVER (PARTITION BY tilt ORDER BY pooled_n DESC, node) - 1 AS i, count(*) OVER (PARTITION BY tilt) AS n FROM picked), xy AS (SELECT node, (CASE tilt WHEN 'panethnic_tilt' THEN -0.64 WHEN 'shared' THEN -0.02 ELSE 0.74 END + CASE WHEN n > 5 THEN 0.024 * ((i % 2) * 2 - 1) ELSE 0 END)::DOUBLE AS x, (CASE WHEN n = 1 THEN 1.7 ELSE 1.7 - 3.4::DOUBLE * i / (n - 1) END - 0.18)::DOUBLE AS y FROM pi), r AS (SELECT *, sqrt(x * x + y * y) AS radius FROM xy) SELECT a.node, (SELECT min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) FROM r b WHERE b.node <> a.node) AS distance, radius, radius <= (SELECT quantile_cont(radius, 0.45) FROM r) AS inner FROM r a", "distance radius"),
        "stopword_antijoin": f"WITH {PANEL} SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{{4,}}')) AS word FROM panel) WHERE NOT list_contains({_LIST(lx.STOPWORDS)}, word) GROUP BY 1",
        "term_totals": f"WITH {_WORDROWS}, wn AS (SELECT file_name, word, count(*) AS n FROM word GROUP BY 1, 2) SELECT file_name, word, n, (sum(n) OVER (PARTITION BY file_name))::BIGINT AS total FROM wn",
        "stem_count": f"""WITH {_WORDROWS}, w1 AS (SELECT regexp_replace(regexp_replace(word, 'sses$', 'ss'), 'ies$', 'y') AS w FROM word),
w2 AS (SELECT CASE WHEN length(w) > 3 AND regexp_matches(w, '[^su]s$') THEN w[:-2] ELSE w END AS w FROM w1),
w3 AS (SELECT CASE WHEN regexp_matches(w, '[aeiouy].*ing$') AND length(w) > 5 THEN w[:-4] WHEN regexp_matches(w, '[aeiouy].*ed$') AND length(w) > 4 THEN w[:-3] ELSE w END AS w FROM w2),
w4 AS (SELECT CASE WHEN length(w) > 4 AND w LIKE '%ly' THEN w[:-3] ELSE w END AS w FROM w3)
SELECT CASE WHEN length(w) > 4 AND w LIKE '%e' THEN w[:-2] ELSE w END AS stem, count(*) AS n FROM w4 GROUP BY 1""",
    }
