"""DuckDB SQL of further queries."""

from __future__ import annotations

from paperloom import lexicon as lx
from paperloom.plans.sql import (
    _DIRECT,
    _FILE,
    _ISO,
    _MONTHLY,
    _SOURCE,
    _STATUS,
    _THEME,
    _YM,
    COMPONENTS,
    FRONTS,
    GATE,
    LABELLED,
    LABELS,
    META,
    NODES,
    PHRASE,
    SCORED,
    WORDS,
    _tokens,
    rounded,
)

#: Of equal words as the engine's: x -> x * a mod m, three times.
_UNIFORM = """
u0 AS (SELECT label, embedding, r AS run, ((vec_id % 2147483647) * 1103515245 + r * 69621 + 42 * 7919 + 12345) % 2147483648 AS x, vec_id FROM embeddings, (SELECT unnest(range({first}, {last})) AS r)),
u1 AS (SELECT * REPLACE (xor(x, x >> 11) * 1103515245 % 2147483648 AS x) FROM u0),
u AS (SELECT * REPLACE (xor(x, x >> 11) * 1103515245 % 2147483648 / 2147483648.0::DOUBLE AS x) FROM u1)
"""


def _wide() -> str:
    part = ", ".join(f"max(n_theme) FILTER (WHERE theme = '{t}') AS {t}_n, max(per100) FILTER (WHERE theme = '{t}') AS {t}_per100" for t in _THEME)
    return f"SELECT year_month, group_name, max(n_paragraphs) AS n_paragraphs, {part} FROM monthly GROUP BY 1, 2"


_FLAGS = """WITH one AS (SELECT paragraph_id, {flags}, coalesce(max(domain_anti_discrimination_equal_opportunity_hits), '') AS both_hits, coalesce(max(panethnic_hits), '') AS p, coalesce(max(ethnic_hits), '') AS e
  FROM paragraph_panel WHERE paragraph_id IS NOT NULL GROUP BY 1),
flags AS (SELECT * EXCLUDE (both_hits), (both_hits LIKE '%discriminat%')::INTEGER AS theme_anti_discrimination,
  (both_hits LIKE '%equal opportunity%' OR both_hits LIKE '%equal employment opportunity%' OR both_hits LIKE '%equal access%')::INTEGER AS theme_equal_opportunity FROM one),
grouped AS (SELECT 'panethnic_appeared' AS group_name, * FROM flags WHERE p <> '' UNION ALL SELECT 'ethnic_appeared', * FROM flags WHERE e <> '')
"""


def _flag_prevalence() -> str:
    own = [t for t in lx.THEMES if t not in ("theme_anti_discrimination", "theme_equal_opportunity")]
    long = " UNION ALL ".join(f"SELECT group_name, '{t}' AS theme, count(*) AS n_paragraphs_group, count(*) FILTER (WHERE {t} = 1) AS n_theme FROM grouped GROUP BY 1" for t in lx.THEMES)
    return _FLAGS.format(flags=", ".join(f"max({t}) AS {t}" for t in own)) + f"SELECT *, 100.0 * n_theme / n_paragraphs_group AS pct_theme FROM ({long})"


_HUB = f"""{PHRASE}, {_DIRECT}, rk AS (SELECT DISTINCT rep AS key, rep[1]::INTEGER AS n, string_split(rep[4:], '|||') AS ws FROM variant)"""
_HUB += LABELLED[LABELLED.index(",\nro AS") :]
_HUB += """, pnodes AS (SELECT label AS node, key AS node_key, any_value(lab.n) AS ngram_n, count(*) AS pan_n, count(*)::DOUBLE / greatest(1, any_value(pan_docs)) AS pan_rate, any_value(score) AS selection_score
FROM recount JOIN lab USING (key) JOIN chosen USING (key) GROUP BY 1, 2 HAVING count(*) >= 8),
ppairs AS (SELECT x.key AS a, y.key AS b, count(*) AS weight_n FROM recount x JOIN recount y ON x.paragraph_id = y.paragraph_id AND x.key < y.key
  WHERE x.key IN (SELECT node_key FROM pnodes) AND y.key IN (SELECT node_key FROM pnodes) GROUP BY 1, 2 HAVING count(*) >= 3 ORDER BY 3 DESC, 1, 2 LIMIT 140)"""


def _tight(strong: int) -> str:
    return f"""{NODES}, strong AS (SELECT from_node AS a, to_node AS b FROM pairs WHERE weight_n >= {strong}), links AS (SELECT a, b FROM strong UNION SELECT b, a FROM strong),
walk AS (SELECT a AS node, a AS seen FROM links UNION SELECT walk.node, links.b FROM walk JOIN links ON links.a = walk.seen),
comp AS (SELECT node, min(seen) AS component FROM walk GROUP BY 1 UNION ALL SELECT node, node FROM nodes WHERE node NOT IN (SELECT a FROM links)),
cid AS (SELECT component, row_number() OVER (ORDER BY sum(pooled_n) DESC, min(node))::INTEGER AS community_id FROM comp JOIN nodes USING (node) GROUP BY 1),
members AS (SELECT node, community_id, row_number() OVER (PARTITION BY community_id ORDER BY pooled_n DESC, node)::INTEGER AS community_rank_in_pooled_n, pooled_n, round(gap_pan_minus_eth, 6) AS gap_pan_minus_eth
  FROM comp JOIN nodes USING (node) JOIN cid USING (component)),
communities AS (SELECT community_id, count(*) AS n_terms, sum(pooled_n)::BIGINT AS total_pooled_n, avg(gap_pan_minus_eth) AS mean_gap_pan_minus_eth,
  CASE WHEN avg(gap_pan_minus_eth) > 0.01 THEN 'panethnic_tilt' WHEN avg(gap_pan_minus_eth) < -0.01 THEN 'ethnic_tilt' ELSE 'shared' END AS community_tilt,
  string_agg(node, ', ' ORDER BY community_rank_in_pooled_n) FILTER (WHERE community_rank_in_pooled_n <= 4) AS community_label,
  string_agg(node, '|' ORDER BY community_rank_in_pooled_n) FILTER (WHERE community_rank_in_pooled_n <= 8) AS top_terms FROM members GROUP BY 1)"""


_POISSON = "CASE WHEN x < 0.367879 THEN 0 WHEN x < 0.735759 THEN 1 WHEN x < 0.919699 THEN 2 WHEN x < 0.981012 THEN 3 ELSE 4 END"

#: Explicit vectors in long form, vec (word, k, value), with k from 1, and as lists, vecs (word, v).
_VECTORS = f"""{WORDS}, pos AS (SELECT paragraph_id, unnest(tokens) AS w, generate_subscripts(tokens, 1) AS i FROM seq),
often AS (SELECT w, count(*) AS n_w FROM pos GROUP BY 1 HAVING count(*) >= 5), topw AS (SELECT w FROM often ORDER BY n_w DESC, w LIMIT 16), dims AS (SELECT w AS other, row_number() OVER (ORDER BY w) AS k FROM topw),
near AS (SELECT x.w AS a, y.w AS b, count(*) AS n FROM pos x JOIN pos y ON x.paragraph_id = y.paragraph_id AND y.i - x.i BETWEEN 1 AND 6 AND x.w <> y.w GROUP BY 1, 2),
sides AS (SELECT word, other, sum(n) AS n FROM (SELECT a AS word, b AS other, n FROM near UNION ALL SELECT b, a, n FROM near) GROUP BY 1, 2),
has AS (SELECT DISTINCT word FROM sides JOIN dims USING (other) WHERE word IN (SELECT w FROM often)),
vec AS (SELECT word, k, coalesce(ln(1.0::DOUBLE + n), 0.0::DOUBLE) AS value FROM has CROSS JOIN dims LEFT JOIN sides USING (word, other)), vecs AS (SELECT word, list(value ORDER BY k) AS v FROM vec GROUP BY 1)"""


def _contexts(late: int, keyword: str) -> str:
    """Contexts of the keyword, ctx (group_period, vec_id, context), their vectors emb (group_period, vec_id, k, value), and the vectors of the words around it, cand (word, v)."""
    period = f"CASE WHEN panethnic_hits <> '' AND ethnic_hits <> '' THEN 'Both' WHEN panethnic_hits <> '' THEN 'Panethnic' WHEN ethnic_hits <> '' THEN 'Ethnic' END || ', ' || CASE WHEN year >= {late} THEN 'Post' WHEN year < {late} THEN 'Pre' END"
    labels = LABELS[LABELS.index("normed AS") :]
    return f"""{_VECTORS}, {labels}, periods AS (SELECT paragraph_id, {period} AS group_period FROM labels),
ctx AS (SELECT group_period, ('0x' || substr(md5(paragraph_id || '|' || (i - 1)), 1, 15))::BIGINT AS vec_id, list_concat(tokens[greatest(1, i - 6):i - 1], tokens[i + 1:i + 6]) AS context
  FROM (SELECT paragraph_id, tokens, unnest(tokens) AS w, generate_subscripts(tokens, 1) AS i FROM seq) JOIN periods USING (paragraph_id) WHERE w = '{keyword}' AND group_period IS NOT NULL),
said AS (SELECT group_period, vec_id, unnest(context) AS word FROM ctx), emb AS (SELECT group_period, vec_id, k, avg(value) AS value FROM said JOIN vec USING (word) GROUP BY 1, 2, 3),
cand AS (SELECT word, v FROM vecs WHERE word IN (SELECT word FROM said) AND word <> '{keyword}')"""


def _drawn(first: int, last: int) -> str:
    """w (…, run, x): the contexts' vectors with the uniform number of each run."""
    return f"""u0 AS (SELECT emb.*, r AS run, ((vec_id % 2147483647) * 1103515245 + r * 69621 + 42 * 7919 + 12345) % 2147483648 AS x FROM emb, (SELECT unnest(range({first}, {last})) AS r)),
u1 AS (SELECT * REPLACE (xor(x, x >> 11) * 1103515245 % 2147483648 AS x) FROM u0), w AS (SELECT * REPLACE (xor(x, x >> 11) * 1103515245 % 2147483648 / 2147483648.0::DOUBLE AS x) FROM u1)"""


def _nearest(late: int, keyword: str) -> str:
    return f"""{_contexts(late, keyword)}, {_drawn(1, 21)}, runs AS (SELECT group_period, run, list(s ORDER BY k) AS m FROM (SELECT group_period, run, k, sum(value * {_POISSON}) AS s, sum({_POISSON}) AS n FROM w GROUP BY 1, 2, 3) WHERE n > 0 GROUP BY 1, 2),
est AS (SELECT group_period, word, round(avg(list_cosine_similarity(v, m)), 9) AS estimate, round(stddev_samp(list_cosine_similarity(v, m)), 9) AS std_error FROM cand, runs GROUP BY 1, 2),
nearest AS (SELECT * FROM (SELECT *, estimate - 1.96 * std_error AS low, estimate + 1.96 * std_error AS high, rank() OVER (PARTITION BY group_period ORDER BY estimate DESC)::INTEGER AS rank FROM est) WHERE rank <= 20)"""


def queries(late: int, keyword: str, strong: int) -> dict[str, str]:
    period = f"CASE WHEN panethnic_hits <> '' AND ethnic_hits <> '' THEN 'Both' WHEN panethnic_hits <> '' THEN 'Panethnic' WHEN ethnic_hits <> '' THEN 'Ethnic' END || ', ' || CASE WHEN year >= {late} THEN 'Post' WHEN year < {late} THEN 'Pre' END"
    per100 = " UNION ALL ".join(f"SELECT year_month, group_name, '{t}' AS theme, {t}_per100 AS rate FROM wide" for t in _THEME)
    similarity = "list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[])"
    columns = "file_name, file_year, file_month, file_issue_date, file_year AS canonical_year, file_month AS canonical_month, file_issue_date AS canonical_issue_date, front_year, front_month"
    return {
        "monthly_wide": rounded(f"WITH {_MONTHLY} {_wide()}", " ".join(f"{t}_per100" for t in _THEME)),
        "monthly_per100": rounded(f"WITH {_MONTHLY}, wide AS ({_wide()}) {per100}", "rate"),
        "group_share_long": rounded(
            f"""WITH {LABELS}, v AS (SELECT {_YM} AS year_month, 100.0 * count(*) FILTER (WHERE panethnic_hits <> '') / count(*) AS p, 100.0 * count(*) FILTER (WHERE ethnic_hits <> '') / count(*) AS e
            FROM labels WHERE year IS NOT NULL AND month BETWEEN 1 AND 12 GROUP BY 1) SELECT year_month, 1 AS level, 'Panethnic' AS group_label, p AS pct FROM v UNION ALL SELECT year_month, 2, 'Ethnic', e FROM v""",
            "pct",
        ),
        "theme_columns": """SELECT column_name AS theme FROM (DESCRIBE paragraph_panel) WHERE regexp_matches(column_name, '^(policy_frame|domain|theme)_') AND column_name NOT LIKE '%\\_hits' ESCAPE '\\'
            AND column_name NOT IN ('policy_frame_data', 'domain_other', 'domain_anti_discrimination_equal_opportunity') UNION ALL SELECT unnest(['theme_anti_discrimination', 'theme_equal_opportunity'])""",
        "flag_prevalence": rounded(_flag_prevalence(), "pct_theme"),
        "group_periods": f"WITH {LABELS} SELECT {period} AS group_period, count(*) AS n FROM labels WHERE {period} IS NOT NULL GROUP BY 1",
        "filtered_panel": f"WITH {GATE} SELECT * EXCLUDE (loaded_at, batch_no) FROM paragraph_panel WHERE paragraph_id IN (SELECT paragraph_id FROM gated WHERE quality_keep = 1)",
        "issue_union": f"""WITH {GATE}, {META}, raw AS (SELECT file_name, count(*) AS n_paragraphs_raw FROM gated GROUP BY 1), fil AS (SELECT file_name, count(*) AS n_paragraphs_filtered FROM gated WHERE quality_keep = 1 GROUP BY 1),
            both_ AS (SELECT coalesce(raw.file_name, fil.file_name) AS file_name, coalesce(n_paragraphs_raw, 0) AS n_paragraphs_raw, coalesce(n_paragraphs_filtered, 0) AS n_paragraphs_filtered FROM raw FULL JOIN fil ON raw.file_name IS NOT DISTINCT FROM fil.file_name)
            SELECT file_name, coalesce(canonical_issue_date, '') AS canonical_issue_date, n_paragraphs_raw, n_paragraphs_filtered FROM both_ LEFT JOIN meta USING (file_name)""",
        "issue_rows": f"""WITH {FRONTS}, f AS (SELECT *, {", ".join(f"{v} AS {k}" for k, v in _FILE.items())} FROM parsed), s AS (SELECT *, {_ISO("file_year", "file_month")} AS file_issue_date, {_SOURCE} AS date_source FROM f)
            SELECT {columns}, {_ISO("front_year", "front_month")} AS front_issue_date, front_volume, front_issue_no, front_period_label, 'pdftotext_layout' AS front_parse_method, front_confidence, date_source,
            date_source = 'conflict' AS date_conflict, {_STATUS("date_source")} AS validation_status, date_source = 'conflict' AS date_review_needed FROM s""",
        "phrase_nodes": rounded(f"WITH {_HUB} SELECT * FROM pnodes", "pan_rate selection_score"),
        "phrase_edges": f"""WITH {_HUB} SELECT 'panethnic_hub' AS from_node, node AS to_node, 'hub_term' AS edge_type, 'Panethnic Hub' AS edge_group, pan_n AS weight_n FROM pnodes
            UNION ALL SELECT x.node, y.node, 'term_term', 'Term-Term', weight_n FROM ppairs JOIN pnodes x ON x.node_key = a JOIN pnodes y ON y.node_key = b""",
        "length_histogram": f"WITH {NODES} SELECT ngram_n, count(*) AS n_nodes FROM nodes GROUP BY 1",
        "tight_communities": rounded(f"WITH RECURSIVE {_tight(strong)} SELECT * FROM communities", "mean_gap_pan_minus_eth"),
        "tight_members": rounded(f"WITH RECURSIVE {_tight(strong)} SELECT * FROM members", "gap_pan_minus_eth"),
        "tight_edges": f"""WITH RECURSIVE {_tight(strong)}, large AS (SELECT node, community_id FROM members JOIN communities USING (community_id) WHERE n_terms >= 2)
            SELECT from_node AS a, to_node AS b, weight_n AS w, x.community_id AS community_a, y.community_id AS community_b FROM pairs JOIN large x ON x.node = from_node JOIN large y ON y.node = to_node""",
        "tight_legend": f"WITH RECURSIVE {_tight(strong)} SELECT community_id, community_label FROM communities WHERE community_id IN (SELECT community_id FROM members WHERE node IN (SELECT node FROM picked)) ORDER BY 1 LIMIT 8",
        "core_nodes": f"WITH {NODES}, most AS (SELECT * FROM pairs ORDER BY weight_n DESC, from_node, to_node LIMIT 220) SELECT from_node AS node FROM most UNION SELECT to_node FROM most",
        "core_nodes_without_edges": f"WITH {NODES} SELECT node FROM nodes ORDER BY pan_n DESC, node LIMIT 20",
        "hub_phrase_stats": rounded(
            f"""WITH {SCORED}, two AS (SELECT * FROM keys WHERE key LIKE '2||%'), t AS (SELECT sum(pan)::BIGINT AS p, sum(eth)::BIGINT AS e FROM (SELECT paragraph_id, max(pan) AS pan, max(eth) AS eth FROM two GROUP BY 1)),
            w AS (SELECT key, sum(pan)::BIGINT AS pan_n, sum(eth)::BIGINT AS eth_n FROM two GROUP BY 1 HAVING greatest(sum(pan), sum(eth)) >= 8)
            SELECT key, pan_n, eth_n, pan_n::DOUBLE / p AS pan_rate, eth_n::DOUBLE / e AS eth_rate, ln(((pan_n + 0.5::DOUBLE) * (e - eth_n + 0.5::DOUBLE)) / ((eth_n + 0.5::DOUBLE) * (p - pan_n + 0.5::DOUBLE))) AS log_odds_pan_vs_eth FROM w, t""",
            "pan_rate eth_rate log_odds_pan_vs_eth",
        ),
        "last_edges": """SELECT least(from_node, to_node) AS a, greatest(from_node, to_node) AS b, arg_max(weight_n, (batch_no, weight_n)) AS w FROM dual_hub_edges
            WHERE edge_type = 'term_term' AND from_node IS NOT NULL AND to_node IS NOT NULL AND weight_n IS NOT NULL GROUP BY 1, 2""",
        "largest_component": f"WITH RECURSIVE {COMPONENTS}, big AS (SELECT component FROM comp GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1) SELECT node, component FROM comp WHERE component IN (FROM big)",
        "track_by_group": rounded(
            f"""WITH {LABELS}, g AS (SELECT paragraph_id, file_name, text, 'panethnic_appeared|' || {_YM} AS document FROM labels WHERE panethnic_hits <> '' UNION ALL SELECT paragraph_id || '#', file_name, text, 'ethnic_appeared|' || {_YM} FROM labels WHERE ethnic_hits <> ''),
            {_tokens("g")}, word AS (SELECT document, unnest(tokens) AS word FROM seq), wn AS (SELECT document, word, count(*) AS n FROM word GROUP BY 1, 2), tot AS (SELECT document, sum(n) AS total FROM wn GROUP BY 1), dfs AS (SELECT word, count(*) AS df FROM wn GROUP BY 1)
            SELECT string_split(document, '|')[1] AS group_name, string_split(document, '|')[2] AS year_month, word, sum(n)::BIGINT AS n, sum(n::DOUBLE / total * ln((SELECT count(*) FROM tot)::DOUBLE / df)) AS tf_idf
            FROM wn JOIN tot USING (document) JOIN dfs USING (word) WHERE regexp_matches(word, '^immigra|^deport|^visa') GROUP BY 1, 2, 3""",
            "tf_idf",
        ),
        "other_words": f"""WITH {WORDS}, p AS (SELECT paragraph_id, tokens, unnest(tokens) AS w, generate_subscripts(tokens, 1) AS i FROM seq)
            SELECT DISTINCT unnest(list_concat(tokens[greatest(1, i - 6):i - 1], tokens[i + 1:i + 6])) AS word FROM p WHERE w = '{keyword}' EXCEPT SELECT '{keyword}'""",
        "knn_ties": rounded(
            f"""SELECT * FROM (SELECT q.vec_id AS query_id, v.vec_id, {similarity} AS similarity, rank() OVER (PARTITION BY q.vec_id ORDER BY {similarity} DESC)::INTEGER AS rank
            FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0) WHERE rank <= 10""",
            "similarity",
        ),
        "bootstrap_means": rounded(
            f"""WITH {_UNIFORM.format(first=1, last=21)}, w AS (SELECT *, CASE WHEN x < 0.367879 THEN 0 WHEN x < 0.735759 THEN 1 WHEN x < 0.919699 THEN 2 WHEN x < 0.981012 THEN 3 ELSE 4 END AS t FROM u),
            e AS (SELECT label, run, t, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS k FROM w WHERE t > 0)
            SELECT label, run::INTEGER AS boot, sum(t)::BIGINT AS n, (k - 1)::INTEGER AS dim, sum(v * t) / sum(t) AS value FROM e GROUP BY 1, 2, k""",
            "value",
        ),
        "contrast_neighbours": rounded(
            f"""WITH {_UNIFORM.format(first=0, last=121)}, share AS (SELECT avg((label % 2)::DOUBLE) AS s FROM embeddings),
            w AS (SELECT *, CASE WHEN run BETWEEN 1 AND 20 THEN CASE WHEN x < 0.367879 THEN 0 WHEN x < 0.735759 THEN 1 WHEN x < 0.919699 THEN 2 WHEN x < 0.981012 THEN 3 ELSE 4 END ELSE 1 END AS t,
              CASE WHEN run > 20 THEN (x < s)::INTEGER ELSE label % 2 END AS g FROM u, share),
            e AS (SELECT run, g, t, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS k FROM w WHERE t > 0),
            m AS (SELECT run, g, list(v ORDER BY k) AS m FROM (SELECT run, g, k, sum(v * t) AS v FROM e GROUP BY 1, 2, 3) GROUP BY 1, 2),
            r AS (SELECT q.vec_id, a.run, list_cosine_similarity(q.embedding::DOUBLE[], a.m) / list_cosine_similarity(q.embedding::DOUBLE[], b.m) AS ratio FROM embeddings q, m a JOIN m b ON a.run = b.run AND a.g = 1 AND b.g = 0 WHERE q.vec_id % 20 = 0),
            s AS (SELECT vec_id, ratio AS seen FROM r WHERE run = 0)
            SELECT vec_id, any_value(seen) AS ratio, stddev_samp(ratio) FILTER (WHERE run BETWEEN 1 AND 20) AS std_error, avg((abs(1 - ratio) >= abs(1 - seen))::INTEGER) FILTER (WHERE run > 20) AS p FROM r JOIN s USING (vec_id) GROUP BY 1""",
            "ratio std_error p",
        ),
        "count_vectors": rounded(f"WITH {_VECTORS} SELECT word, (k - 1)::INTEGER AS dim, value FROM vec", "value"),
        "context_vectors": rounded(f"WITH {_VECTORS} SELECT s.word, sum(n)::BIGINT AS n, (k - 1)::INTEGER AS dim, sum(n * value) / sum(n) AS value FROM sides s JOIN vec ON vec.word = s.other GROUP BY s.word, k", "value"),
        "keyword_vectors": rounded(f"WITH {_contexts(late, keyword)} SELECT group_period, count(*) AS n, (k - 1)::INTEGER AS dim, avg(value) AS value FROM emb GROUP BY 1, k", "value"),
        "bootstrap_neighbours": rounded(f"WITH {_nearest(late, keyword)} SELECT * FROM nearest", "estimate std_error low high"),
        "shared_neighbours": rounded(f"WITH {_nearest(late, keyword)} SELECT * FROM nearest WHERE word IN (SELECT word FROM nearest GROUP BY 1 HAVING count(*) > 1)", "estimate std_error low high"),
        "keyword_examples": rounded(
            f"""WITH {_contexts(late, keyword)}, own AS (SELECT group_period, vec_id, list(value ORDER BY k) AS e FROM emb GROUP BY 1, 2), total AS (SELECT group_period, list(s ORDER BY k) AS m FROM (SELECT group_period, k, sum(value) AS s FROM emb GROUP BY 1, 2) GROUP BY 1),
            s AS (SELECT group_period, vec_id, round(list_cosine_similarity(e, m), 9) AS similarity FROM own JOIN total USING (group_period)),
            r AS (SELECT *, row_number() OVER (PARTITION BY group_period ORDER BY similarity DESC, vec_id)::INTEGER AS rank FROM s) SELECT r.group_period, r.vec_id, array_to_string(context, ' ') AS context, similarity, rank FROM r JOIN ctx USING (vec_id) WHERE rank <= 5""",
            "similarity",
        ),
        "keyword_contrast": rounded(
            f"""WITH {_contexts(late, keyword)}, {_drawn(0, 121)}, one AS (SELECT *, (group_period LIKE 'Panethnic%')::INTEGER AS own FROM w WHERE group_period LIKE 'Panethnic%' OR group_period LIKE 'Ethnic%'), share AS (SELECT avg(own) AS s FROM one),
            g AS (SELECT run, k, value, CASE WHEN run > 20 THEN (x < s)::INTEGER ELSE own END AS g, CASE WHEN run BETWEEN 1 AND 20 THEN {_POISSON} ELSE 1 END AS t FROM one, share),
            m AS (SELECT run, g, list(v ORDER BY k) AS m FROM (SELECT run, g, k, sum(value * t) AS v, sum(t) AS n FROM g GROUP BY 1, 2, 3) WHERE n > 0 GROUP BY 1, 2),
            r AS (SELECT word, a.run, list_cosine_similarity(v, a.m) / list_cosine_similarity(v, b.m) AS ratio FROM cand, m a JOIN m b ON a.run = b.run AND a.g = 1 AND b.g = 0), s AS (SELECT word, ratio AS seen FROM r WHERE run = 0)
            SELECT word, any_value(seen) AS ratio, stddev_samp(ratio) FILTER (WHERE run BETWEEN 1 AND 20) AS std_error, avg((abs(1 - ratio) >= abs(1 - seen))::INTEGER) FILTER (WHERE run > 20) AS p FROM r JOIN s USING (word) GROUP BY 1""",
            "ratio std_error p",
        ),
        "skipgrams": f"""WITH {WORDS}, p AS (SELECT paragraph_id, tokens, unnest(tokens) AS w, generate_subscripts(tokens, 1) AS i FROM seq),
            good AS (SELECT w AS target, unnest(tokens[i + 1:i + 3]) AS context, 1 AS label FROM p),
            bad AS (SELECT w AS target, tokens[1 + (i - 1 + (i - 1) * 7919 + ascii(w) * 104729 + 42 * 31) % len(tokens)] AS context, 0 AS label FROM p)
            SELECT target, context, label, count(*) AS n FROM (FROM good UNION ALL FROM bad) GROUP BY 1, 2, 3""",
    }
