"""Named queries over the tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from paperloom import lexicon as lx
from paperloom.functions import text as tx
from paperloom.functions.stats import with_totals
from paperloom.operators import contexts, embed, graph, layout, metadata, network, panel, themes
from paperloom.plans import more_sql, sql
from paperloom.session import cut_lineage
from paperloom.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
LEX = lx.TermLexicon()
PAGE_WIDTH = 612.0
FIRST_LATE_YEAR = 1976
STRONG = 4
KEYWORD = "school"
_QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    """Registers a query; its doubles are rounded to six places, as its SQL's are."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        df = f(spark, folder)
        rounded = {c: F.round(c, 6) for c, kind in df.dtypes if kind == "double"}
        return df.withColumns(rounded | {c: F.transform(c, lambda x: F.round(x, 6)) for c, kind in df.dtypes if kind == "array<double>"})

    _QUERIES[f.__name__] = run
    return f


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return sql.queries() | more_sql.queries(FIRST_LATE_YEAR, KEYWORD, STRONG)


def _paragraphs(s: SparkSession, d: str) -> DataFrame:
    return panel.once(table(s, d, "paragraph_panel"))


def _labels(s: SparkSession, d: str) -> DataFrame:
    return panel.labelled(_paragraphs(s, d))


def _themed(s: SparkSession, d: str) -> DataFrame:
    return panel.themed(_labels(s, d))


def _lines(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "line_text")


# Labels


@query
def theme_contrast(s, d):
    return themes.contrast(themes.prevalence(_themed(s, d)))


@query
def theme_prevalence(s, d):
    return themes.prevalence(_themed(s, d))


@query
def identity_type(s, d):
    return _labels(s, d).select("paragraph_id", panel.identity_type().alias("identity_type"), panel.domain_other().alias("domain_other"))


@query
def pattern_hits(s, d):
    cols = [f"{k}_hits" for k in lx.ALL_PATTERNS]
    return _labels(s, d).select("paragraph_id", *cols).unpivot(["paragraph_id"], cols, "label", "hits").where("hits <> ''").withColumn("label", F.regexp_replace("label", "_hits$", ""))


@query
def split_theme(s, d):
    return _themed(s, d).where(F.col(f"{lx.COMBINED}_hits") != "").select("paragraph_id", F.col("theme_anti_discrimination").cast("int").alias("anti"), F.col("theme_equal_opportunity").cast("int").alias("equal"))


@query
def monthly_theme(s, d):
    return themes.monthly(_themed(s, d))


@query
def group_share_gap(s, d):
    return themes.share_gap(_themed(s, d))


@query
def complete_grid(s, d):
    return themes.complete(themes.monthly(_themed(s, d)))


@query
def normalize_max100(s, d):
    return themes.max100(themes.complete(themes.monthly(_themed(s, d)))).drop("per100")


@query
def gap_ribbon(s, d):
    return themes.gaps(themes.complete(themes.monthly(_themed(s, d))))


@query
def gap_change(s, d):
    return themes.gap_change(themes.gaps(themes.complete(themes.monthly(_themed(s, d)))))


@query
def axis_breaks(s, d):
    return themes.every_kth(themes.monthly(_themed(s, d)))


@query
def key_themes(s, d):
    wanted = ["domain_education", "domain_health", "domain_housing", "domain_immigration", "domain_employment_labor", "policy_frame_funding"]
    return themes.only_present(themes.counts(_themed(s, d)).unpivot(["group_name"], lx.THEMES, "theme", "n"), wanted)


@query
def monthly_wide(s, d):
    return themes.monthly_wide(_themed(s, d))


@query
def monthly_per100(s, d):
    """The wide table made long again by the ends of its names."""
    return themes.long_by_suffix(themes.monthly_wide(_themed(s, d)), ["year_month", "group_name"], "_per100", "rate")


@query
def group_share_long(s, d):
    return themes.share_long(themes.share_gap(_themed(s, d)))


@query
def theme_columns(s, d):
    return s.createDataFrame([(c,) for c in themes.theme_columns(table(s, d, "paragraph_panel").columns)], "theme string")


@query
def flag_prevalence(s, d):
    """theme_prevalence from the flags and hits that the panel holds, over the themes that its columns name."""
    rows = table(s, d, "paragraph_panel")
    return themes.prevalence(themes.from_flags(rows), themes.theme_columns(rows.columns)).drop("theme_pretty")


@query
def group_periods(s, d):
    label = panel.group_period(F.col("year"), FIRST_LATE_YEAR)
    return _labels(s, d).select(label.alias("group_period")).where("group_period is not null").groupBy("group_period").agg(F.count("*").alias("n"))


@query
def table_prevalence(s, d):
    rows = table(s, d, "paragraph_theme_prevalence_by_group").distinct()
    return rows.select("batch_no", "group_name", "theme", themes.pretty(F.regexp_replace("theme", "^(domain|theme)_", "")).alias("pretty"), F.coalesce(F.try_divide(100.0 * F.col("n_theme"), F.greatest("n_paragraphs_group", F.lit(1))), F.lit(0.0)).alias("pct"))


# Quality and summaries


@query
def text_metrics(s, d):
    rows = _paragraphs(s, d).withColumns(tx.metrics(F.col("text")))
    return rows.drop("file_name", "year", "month", "text")


@query
def quality_filter(s, d):
    return panel.gated(_labels(s, d)).select("paragraph_id", "quality_keep", "quality_reason")


@query
def quality_split(s, d):
    return panel.gated(_labels(s, d)).groupBy("quality_reason").agg(F.count("*").alias("n"), F.sum("quality_keep").alias("n_kept"))


@query
def filtered_panel(s, d):
    """The rows of kept paragraphs with the panel's own columns, but for those of loading."""
    return panel.kept(table(s, d, "paragraph_panel").drop("loaded_at", "batch_no"), panel.gated(_labels(s, d)))


@query
def issue_union(s, d):
    return panel.issue_union(panel.gated(_labels(s, d)), metadata.last_loaded(table(s, d, "issue_metadata")))


@query
def issue_summary(s, d):
    return panel.issue_summary(panel.gated(_labels(s, d)))


@query
def corpus_summary(s, d):
    return panel.corpus_summary(panel.issue_summary(panel.gated(_labels(s, d))))


@query
def key_union(s, d):
    a = table(s, d, "paragraph_panel").select("file_name").distinct().withColumn("in_panel", F.lit(1))
    b = table(s, d, "issue_metadata").select("file_name").distinct().withColumn("in_metadata", F.lit(1))
    return a.join(b, "file_name", "full_outer").fillna(0, ["in_panel", "in_metadata"])


@query
def issue_lookup(s, d):
    meta = metadata.last_loaded(table(s, d, "issue_metadata")).select("file_name", "canonical_issue_date", "validation_status")
    rows = _paragraphs(s, d).select("paragraph_id", "file_name").join(meta, "file_name", "left")
    return rows.select("paragraph_id", F.coalesce("canonical_issue_date", F.lit("")).alias("issue_date"), F.coalesce("validation_status", F.lit("")).alias("status"))


# Dates


def _fronts(s: SparkSession, d: str) -> DataFrame:
    first = layout.latest(_lines(s, d).where("page_number = 1")).where("text is not null").groupBy("file_name").agg(layout.joined("text", "\n").alias("front_text"))
    return metadata.front_parsed(first).drop("front_text")


@query
def filename_date(s, d):
    return table(s, d, "issue_metadata").select("file_name").distinct().withColumns(metadata.filename_date())


@query
def front_parse(s, d):
    return _fronts(s, d)


@query
def resolve_date_source(s, d):
    return metadata.resolved(_fronts(s, d)).select("file_name", "date_source", "date_conflict", "validation_status", "front_issue_date", "canonical_issue_date")


@query
def issue_rows(s, d):
    return metadata.issue_rows(_fronts(s, d))


@query
def date_conflicts(s, d):
    return metadata.last_loaded(table(s, d, "issue_metadata")).where("date_conflict").select("file_name", "file_issue_date", "front_year", "front_month", "validation_status")


@query
def parse_outcomes(s, d):
    return metadata.last_loaded(table(s, d, "issue_metadata")).groupBy("date_source").agg(F.count("*").alias("n"), F.count_if("date_review_needed").alias("n_review"))


@query
def table_date_source(s, d):
    rows = metadata.last_loaded(table(s, d, "issue_metadata")).withColumn("derived", metadata.date_source())
    return rows.select("file_name", "derived", metadata.validation_status(F.col("derived")).alias("derived_status"))


@query
def best_parse(s, d):
    rows = metadata.last_loaded(table(s, d, "issue_metadata"))
    rows = rows.select("file_name", F.struct(F.col("front_year").alias("year"), F.col("front_month").alias("month")).alias("first"), F.struct(F.col("file_year").alias("year"), F.col("file_month").alias("month")).alias("second"))
    best = metadata.better("first", "second")
    return rows.select("file_name", best["year"].alias("year"), best["month"].alias("month"))


# Layout


@query
def gap_segmentation(s, d):
    return layout.segments(layout.latest(_lines(s, d))).select("line_id", "paragraph_in_column")


@query
def paragraph_sequence(s, d):
    return layout.paragraphs(_lines(s, d)).select("paragraph_id", "paragraph_in_column", "paragraph_in_page", "paragraph_text")


@query
def page_text(s, d):
    return layout.page_texts(_lines(s, d))


@query
def issue_text(s, d):
    return layout.issue_texts(layout.page_texts(_lines(s, d)))


@query
def column_cluster(s, d):
    return layout.column_centers(layout.latest(_lines(s, d)), PAGE_WIDTH)


@query
def nearest_column(s, d):
    rows = layout.latest(_lines(s, d))
    return layout.nearest_column(rows, layout.column_centers(rows, PAGE_WIDTH))


@query
def line_debris(s, d):
    return layout.without_debris(layout.latest(_lines(s, d))).select("line_id", "file_name")


@query
def layout_clean(s, d):
    return layout.latest(_lines(s, d)).where("text is not null").select("line_id", tx.layout_clean(F.col("text")).alias("clean"))


# Terms


def _terms(s: SparkSession, d: str) -> DataFrame:
    return network.term_rows(_labels(s, d), LEX)


def _stored_terms(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Terms, candidate keys and scores, each written once as several steps read them."""
    terms = cut_lineage(_terms(s, d))
    keys = cut_lineage(network.keyed(terms, LEX))
    return terms, keys, cut_lineage(network.scored(keys, network.support(network.keyed(terms, LEX, 1, 1))))


def _keys(s: SparkSession, d: str) -> DataFrame:
    return network.keyed(_terms(s, d), LEX)


def _scored(s: SparkSession, d: str) -> DataFrame:
    return _stored_terms(s, d)[2]


def _merged(scored: DataFrame, k: int = 90, by: str = "select_score") -> DataFrame:
    """At most k rows, written once."""
    return cut_lineage(network.variants(cut_lineage(network.selected(scored, k, by))))


@query
def token_sequence(s, d):
    return _terms(s, d).select("paragraph_id", F.array_join("tokens", " ").alias("tokens"))


@query
def ngram_df(s, d):
    return network.support(_keys(s, d))


@query
def directional_bigram(s, d):
    return network.directional(_terms(s, d))


@query
def doc_totals(s, d):
    return network.doc_totals(_keys(s, d))


@query
def pmi_score(s, d):
    return _scored(s, d).select("key", "n", "pmi", "score", "gap", "select_score")


@query
def select_terms(s, d):
    return network.selected(_scored(s, d)).select("key", "pooled_n")


@query
def merge_stats(s, d):
    merged = _merged(_scored(s, d))
    return merged.agg(F.count("*").alias("n_keys"), F.count_if(F.col("key") != F.col("rep")).alias("n_merged"))


@query
def variant_merge(s, d):
    return _merged(_scored(s, d))


@query
def rep_recount(s, d):
    _, keys, scored = _stored_terms(s, d)
    rows = network.recounted(keys, _merged(scored))
    return rows.groupBy("key").agg(F.sum("pan").alias("pan_n"), F.sum("eth").alias("eth_n"))


def _network(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    terms, keys, scored = _stored_terms(s, d)
    merged = _merged(scored)
    recount = network.recounted(keys, merged)
    labels = network.labelled_keys(merged.select(F.col("rep").alias("key")), network.directional(terms), LEX)
    labels = cut_lineage(labels)
    node = cut_lineage(network.nodes(recount, labels, network.doc_totals(keys)))
    return node, network.pair_counts(recount, labels, node)


@query
def label_terms(s, d):
    terms, _, scored = _stored_terms(s, d)
    return network.labelled_keys(_merged(scored).select(F.col("rep").alias("key")), network.directional(terms), LEX)


@query
def dual_hub_nodes(s, d):
    return _network(s, d)[0]


@query
def dual_hub_edges(s, d):
    return network.edges(*_network(s, d))


@query
def pair_counts(s, d):
    return _network(s, d)[1]


@query
def choose_nodes(s, d):
    return network.choose(_network(s, d)[0])


@query
def grouped_layout(s, d):
    return graph.layout(network.choose(_network(s, d)[0]))


def _single_hub(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The nodes of one group by its own support, and its recounted keys."""
    terms = cut_lineage(_terms(s, d).where("pan = 1").withColumn("eth", F.lit(0)))
    keys = cut_lineage(network.keyed(terms, LEX))
    rows = cut_lineage(network.selected(network.scored(keys, network.support(network.keyed(terms, LEX, 1, 1))), 70, "score"))
    merged = cut_lineage(network.variants(rows))
    recount = network.recounted(keys, merged)
    labels = network.labelled_keys(merged.select(F.col("rep").alias("key")), network.directional(terms), LEX)
    return cut_lineage(network.single_hub_nodes(recount, rows, labels, network.doc_totals(keys))), recount


@query
def phrase_nodes(s, d):
    return _single_hub(s, d)[0]


@query
def phrase_edges(s, d):
    node, recount = _single_hub(s, d)
    return network.single_hub_edges(recount, node)


@query
def length_histogram(s, d):
    return network.length_histogram(_network(s, d)[0])


def _tight(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Nodes, edges between them, and the table and members of fixed communities: the components of the strong pairs, nodes without one alone."""
    node, pairs = _network(s, d)
    g = cut_lineage(pairs.select(F.col("from_node").alias("a"), F.col("to_node").alias("b"), F.col("weight_n").alias("w")))
    members = graph.components(g.where(F.col("w") >= STRONG))
    alone = node.select("node", F.col("node").alias("component")).join(members, "node", "left_anti")
    rows = graph.ranked(members.unionByName(alone), "component", node.select("node", F.col("pooled_n").alias("weight")))
    return node, g, *graph.community_table(rows, node, 1)


@query
def tight_communities(s, d):
    return _tight(s, d)[2]


@query
def tight_members(s, d):
    return _tight(s, d)[3]


@query
def tight_edges(s, d):
    """Edges between the members of communities of two or more, with the communities of their ends."""
    _, g, communities, members = _tight(s, d)
    return graph.restricted(g, members.join(communities.where("n_terms >= 2").select("community_id"), "community_id", "left_semi"))


@query
def tight_legend(s, d):
    """The communities of the chosen nodes."""
    node, _, communities, members = _tight(s, d)
    return graph.legend(communities, members.join(network.choose(node).select("node"), "node", "left_semi")).select("community_id", "community_label")


@query
def network_communities(s, d):
    """The community table of Louvain over all pairs, lone nodes included."""
    node, pairs = _network(s, d)
    g = cut_lineage(pairs.select(F.col("from_node").alias("a"), F.col("to_node").alias("b"), F.col("weight_n").alias("w")))
    found = graph.louvain(g, seed=42, nodes=node)
    return graph.community_table(graph.ranked(found, "community", node.select("node", F.col("pooled_n").alias("weight"))), node)[0]


@query
def core_nodes(s, d):
    node, pairs = _network(s, d)
    return graph.core_nodes(node, network.edges(node, pairs))


@query
def core_nodes_without_edges(s, d):
    node, pairs = _network(s, d)
    return graph.core_nodes(node, network.edges(node, pairs.where("false")))


@query
def hub_phrase_stats(s, d):
    keys = _keys(s, d).where(F.col("key").startswith("2||"))
    words = network.support(keys).where(F.greatest("pan_n", "eth_n") >= 8)
    rows = with_totals(words, network.doc_totals(keys).select(F.col("pan_docs").alias("p"), F.col("eth_docs").alias("e")))
    rows = network.log_odds(rows, F.col("p"), F.col("e"))
    return rows.select("key", "pan_n", "eth_n", (F.col("pan_n") / F.col("p")).alias("pan_rate"), (F.col("eth_n") / F.col("e")).alias("eth_rate"), "log_odds_pan_vs_eth")


@query
def hub_word_stats(s, d):
    words = _terms(s, d).select("pan", "eth", F.explode(F.array_distinct("tokens")).alias("word")).groupBy("word").agg(F.sum("pan").alias("pan_n"), F.sum("eth").alias("eth_n"))
    rows = with_totals(words.where(F.greatest("pan_n", "eth_n") >= 8), _terms(s, d).agg(F.sum("pan").alias("p"), F.sum("eth").alias("e")))
    rows = network.log_odds(rows, F.col("p"), F.col("e"))
    return rows.select("word", "pan_n", "eth_n", (F.col("pan_n") / F.col("p")).alias("pan_rate"), (F.col("eth_n") / F.col("e")).alias("eth_rate"), "log_odds_pan_vs_eth")


# Graphs, over the given edges


def _graph(s: SparkSession, d: str) -> DataFrame:
    return graph.undirected(table(s, d, "dual_hub_edges").where("edge_type = 'term_term'").dropDuplicates(["batch_no", "file_name", "from_node", "to_node", "weight_n"]))


def _weights(g: DataFrame) -> DataFrame:
    return g.select(F.col("a").alias("node"), "w").unionByName(g.select(F.col("b").alias("node"), "w")).groupBy("node").agg(F.sum("w").alias("weight"))


@query
def graph_edges(s, d):
    return _graph(s, d)


@query
def connected_components(s, d):
    return graph.components(_graph(s, d).where("w >= 3"))


@query
def component_summary(s, d):
    g = _graph(s, d).where("w >= 3")
    return graph.community_summary(graph.ranked(graph.components(g), "component", _weights(g)))


@query
def community_labels(s, d):
    g = _graph(s, d).where("w >= 3")
    return graph.ranked(graph.components(g), "component", _weights(g)).where("community_rank <= 5")


@query
def louvain(s, d):
    return graph.louvain(_graph(s, d))


@query
def community_summary(s, d):
    g = _graph(s, d)
    return graph.community_summary(graph.ranked(graph.louvain(g), "community", _weights(g)))


@query
def edge_filter(s, d):
    g = _graph(s, d)
    return graph.induced(g, _weights(g).where("weight >= 10"))


@query
def drop_terms(s, d):
    return graph.without(_graph(s, d), ["budget", "field office"])


@query
def hub_row(s, d):
    return graph.with_hub(_weights(_graph(s, d)), "panethnic_hub")


@query
def vertex_size(s, d):
    return graph.scaled(_weights(_graph(s, d)), "weight", "size", 4.0, 20.0, 0.5).select("node", "size")


@query
def last_edges(s, d):
    """Edges of which the last batch counts, instead of their sum."""
    return graph.last_written(table(s, d, "dual_hub_edges").where("edge_type = 'term_term'"), "batch_no")


@query
def largest_component(s, d):
    return graph.largest(graph.components(_graph(s, d).where("w >= 3")))


@query
def edge_width(s, d):
    rows = table(s, d, "hub_word_edges").where("cooccur_n is not null").groupBy("hub", "to_node").agg(F.sum("cooccur_n").alias("n"))
    most = rows.groupBy("hub").agg(F.max("n").alias("most"))  # one row a hub
    return rows.join(F.broadcast(most), "hub").select("hub", "to_node", "n", (0.4 + 2.6 * F.col("n") / F.col("most")).alias("width"))


# Words and vectors


def _words(s: SparkSession, d: str) -> DataFrame:
    return _paragraphs(s, d).select("paragraph_id", "file_name", tx.term_sequence(F.col("text"), LEX).alias("tokens"))


@query
def fcm_window(s, d):
    return embed.pruned_pairs(_words(s, d), "paragraph_id")


@query
def pairwise_pmi(s, d):
    return embed.window_pmi(_words(s, d), "paragraph_id")


@query
def kwic(s, d):
    return embed.keyword_in_context(_words(s, d), "paragraph_id", "grant")


@query
def slide_windows(s, d):
    return embed.windows(_words(s, d), "paragraph_id").select("paragraph_id", "window_no", F.array_join("window", " ").alias("words"))


@query
def tf_idf(s, d):
    return embed.tf_idf(_words(s, d).select("file_name", F.explode("tokens").alias("word")), "file_name")


@query
def track_keyword(s, d):
    rows = embed.tf_idf(_words(s, d).select("file_name", F.explode("tokens").alias("word")), "file_name")
    return rows.where(F.col("word").rlike("^immigra|^deport|^visa")).groupBy("word").agg(F.sum("n").alias("n"), F.sum("tf_idf").alias("tf_idf"))


@query
def track_by_group(s, d):
    """Counts and weights of words around a keyword by group and month; a month of a group is a document."""
    rows = themes.in_groups(_labels(s, d)).select("group_name", themes.month_key(F.col("year"), F.col("month")).alias("year_month"), tx.term_sequence(F.col("text"), LEX).alias("tokens"))
    words = rows.select(F.concat_ws("|", "group_name", "year_month").alias("document"), F.explode("tokens").alias("word"))
    found = embed.tf_idf(words, "document").where(F.col("word").rlike("^immigra|^deport|^visa"))
    part = F.split("document", r"\|")
    return found.groupBy(part[0].alias("group_name"), part[1].alias("year_month"), "word").agg(F.sum("n").alias("n"), F.sum("tf_idf").alias("tf_idf"))


@query
def other_words(s, d):
    """The vocabulary around a keyword, without the keyword itself."""
    return contexts.vocabulary(contexts.contexts(_words(s, d), "paragraph_id", KEYWORD), KEYWORD)


@query
def top_terms(s, d):
    rows = _words(s, d).select("file_name", F.explode("tokens").alias("word")).groupBy("file_name", "word").agg(F.count("*").alias("n"))
    return embed.top_with_ties(rows, "file_name", "n", 10)


@query
def vocab_prune(s, d):
    return _words(s, d).select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count("*").alias("n")).where("n >= 5")


@query
def clean_corpus(s, d):
    return table(s, d, "documents").where("text is not null and text <> ''").select("doc_id", tx.corpus_clean(F.col("text"), lx.FUNCTION_WORDS).alias("clean"))


@query
def both_groups(s, d):
    words = _terms(s, d).select("pan", "eth", F.explode(F.array_distinct("tokens")).alias("word")).groupBy("word").agg(F.sum("pan").alias("pan_n"), F.sum("eth").alias("eth_n"))
    return words.where("pan_n > 0 and eth_n > 0")


@query
def stem_count(s, d):
    return _words(s, d).select(F.explode("tokens").alias("word")).groupBy(embed.stem(F.col("word")).alias("stem")).agg(F.count("*").alias("n"))


@query
def skipgrams(s, d):
    return embed.skipgrams(_words(s, d), "paragraph_id").groupBy("target", "context", "label").agg(F.count("*").alias("n"))


@query
def cosine_knn(s, d):
    v = table(s, d, "embeddings")
    return embed.neighbours(v, v.where("vec_id % 20 = 0"))


@query
def knn_ties(s, d):
    """The nearest vectors with all that are as near as the tenth."""
    v = table(s, d, "embeddings")
    return embed.neighbours(v, v.where("vec_id % 20 = 0"), ties=True)


@query
def knn_overlap(s, d):
    """Of each pair of neighbouring query vectors, which lists of nearest vectors a vector stands in."""
    v = table(s, d, "embeddings")
    near = embed.neighbours(v, v.where("vec_id % 20 = 0")).select(F.floor(F.col("query_id") / 40).alias("pair"), "query_id", "vec_id")
    found = near.groupBy("pair", "vec_id").agg(F.min("query_id").alias("lo"), F.max("query_id").alias("hi"))
    return found.select("pair", "vec_id", F.when(F.col("lo") < F.col("hi"), "shared").when(F.col("lo") % 40 == 0, "first only").otherwise("second only").alias("class"))


@query
def analogy_knn(s, d):
    return embed.analogy(table(s, d, "embeddings"), 3, 2, 1)


@query
def mean_similarity(s, d):
    v = table(s, d, "embeddings")
    near = embed.neighbours(v, v.where("vec_id % 20 = 0"), 50).join(v.select("vec_id", "label"), "vec_id")
    return near.groupBy("query_id", "label").agg(F.avg("similarity").alias("mean_similarity"))


@query
def confidence_band(s, d):
    v = table(s, d, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x"))
    v = v.groupBy("label", "dim").agg(F.avg(F.col("x").cast("double")).alias("est"), F.stddev_samp(F.col("x").cast("double")).alias("sd"), F.count("*").alias("n"))
    se = F.col("sd") / F.sqrt("n")
    return v.select("label", "dim", "est", (F.col("est") - 1.96 * se).alias("low"), (F.col("est") + 1.96 * se).alias("high"))


@query
def bootstrap_means(s, d):
    means = embed.bootstrap_means(table(s, d, "embeddings"), "label")
    return means.select("label", "boot", F.col("n").cast("long").alias("n"), F.posexplode("embedding").alias("dim", "value"))


def _vectors(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Words, and Word2Vec over them as the built-in stand-in for co-occurrence embeddings."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    words = cut_lineage(_words(s, d))
    model = Word2Vec(vectorSize=50, minCount=5, maxIter=1, seed=42, numPartitions=2, inputCol="tokens", outputCol="v").fit(words.select("tokens"))
    return words, cut_lineage(model.getVectors().select("word", vector_to_array("vector").alias("vector")))


@query
def word_vectors(s, d):
    return _vectors(s, d)[1]


@query
def transform_matrix(s, d):
    words, vectors = _vectors(s, d)
    return embed.transform_matrix(embed.around(words, "paragraph_id", vectors), vectors)


def _counted_vectors(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Words and their explicit vectors."""
    words = cut_lineage(_words(s, d))
    return words, cut_lineage(embed.count_vectors(words, "paragraph_id"))


def _long(rows: DataFrame, vector: str, *keys: str) -> DataFrame:
    return rows.select(*keys, F.posexplode(vector).alias("dim", "value"))


@query
def count_vectors(s, d):
    return _long(_counted_vectors(s, d)[1], "vector", "word")


@query
def context_vectors(s, d):
    words, vectors = _counted_vectors(s, d)
    return _long(embed.around(words, "paragraph_id", vectors), "context", "word", "n")


def _contexts(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Contexts of a keyword by group and period, their vectors, and those of the words around it."""
    _, vectors = _counted_vectors(s, d)
    label = panel.group_period(F.col("year"), FIRST_LATE_YEAR)
    rows = _labels(s, d).select("paragraph_id", label.alias("group_period"), tx.term_sequence(F.col("text"), LEX).alias("tokens")).where("group_period is not null")
    found = cut_lineage(contexts.contexts(rows, "paragraph_id", KEYWORD, ("group_period",)))
    around = vectors.join(contexts.vocabulary(found, KEYWORD), "word")
    return found, cut_lineage(contexts.embedded(found, vectors, None, ("group_period",))), around


@query
def keyword_vectors(s, d):
    """The mean vector of a keyword's contexts by group and period."""
    sums = embed.weighted_sums(_contexts(s, d)[1], ["group_period"], lambda part, run: np.ones(len(part)), 1)
    return _long(sums.select("group_period", F.col("n").cast("long").alias("n"), F.transform("total", lambda v: v / F.col("n")).alias("v")), "v", "group_period", "n")


@query
def transformed_contexts(s, d):
    """Contexts of a keyword as word vectors, by the transform matrix of the corpus."""
    words, vectors = _vectors(s, d)
    matrix = embed.transform_matrix(embed.around(words, "paragraph_id", vectors), vectors)
    return contexts.embedded(contexts.contexts(words, "paragraph_id", KEYWORD), vectors, matrix)


@query
def bootstrap_neighbours(s, d):
    _, rows, around = _contexts(s, d)
    return contexts.nearest_words(rows, around, ("group_period",))


@query
def shared_neighbours(s, d):
    """The nearest words that several groups and periods share."""
    _, rows, around = _contexts(s, d)
    return contexts.in_both(contexts.nearest_words(rows, around, ("group_period",)), "group_period")


@query
def keyword_examples(s, d):
    found, rows, _ = _contexts(s, d)
    return contexts.examples(found, rows, ("group_period",))


@query
def keyword_contrast(s, d):
    """How much nearer the words around a keyword are to its contexts in one group than in the other."""
    _, rows, around = _contexts(s, d)
    rows = rows.where("group_period like 'Panethnic%' or group_period like 'Ethnic%'").withColumn("g", F.col("group_period").startswith("Panethnic").cast("int"))
    targets = around.select(F.xxhash64("word").alias("vec_id"), F.col("vector").alias("embedding"))
    return around.select("word", F.xxhash64("word").alias("vec_id")).join(embed.contrast_neighbours(rows, "g", targets), "vec_id").drop("vec_id")


@query
def contrast_neighbours(s, d):
    v = table(s, d, "embeddings").withColumn("g", (F.col("label") % 2).cast("int"))
    return embed.contrast_neighbours(v, "g", v.where("vec_id % 20 = 0"))


@query
def nearest_vertex(s, d):
    return graph.nearest_vertex(graph.layout(network.choose(_network(s, d)[0])))


@query
def stopword_antijoin(s, d):
    words = _paragraphs(s, d).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))).alias("word"))
    stop = s.createDataFrame([(w,) for w in lx.STOPWORDS], "word string")
    return words.join(F.broadcast(stop), "word", "left_anti").groupBy("word").agg(F.count("*").alias("n"))


@query
def term_totals(s, d):
    n = cut_lineage(_words(s, d).select("file_name", F.explode("tokens").alias("word")).groupBy("file_name", "word").agg(F.count("*").alias("n")))
    total = n.groupBy("file_name").agg(F.sum("n").alias("total"))
    return n.join(total, "file_name", "left")
