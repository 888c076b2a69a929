"""Terms of paragraphs, their support and score, and the network of terms and groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from paperloom.functions import text as tx
from paperloom.functions.stats import with_totals
from paperloom.lexicon import TermLexicon
from paperloom.operators.panel import flag

TILT = 0.01


def term_rows(labels: DataFrame, lex: TermLexicon) -> DataFrame:
    """(paragraph_id, pan, eth, tokens) of paragraphs with a group label; the others are dropped before they are tokenised."""
    rows = labels.where(flag("panethnic") | flag("ethnic"))
    return rows.select("paragraph_id", flag("panethnic").cast("int").alias("pan"), flag("ethnic").cast("int").alias("eth"), tx.term_sequence(F.col("text"), lex).alias("tokens"))


def gram_key(tokens: Column, n: int) -> Column:
    """n||t1|||t2: pairs in alphabetical order, others in their own."""
    return F.concat(F.lit(f"{n}||"), F.array_join(F.array_sort(tokens) if n == 2 else tokens, "|||"))


def candidates(tokens: Column, lex: TermLexicon, min_n: int, max_n: int) -> Column:
    """Distinct keys of the n-grams that hold a policy term; a pair of equal words is none."""
    policy = F.array(*map(F.lit, lex.policy))

    def of(n: int) -> Column:
        kept = F.filter(tx.grams(tokens, n), lambda g: F.arrays_overlap(g, policy) & ((g[0] != g[1]) if n == 2 else F.lit(True)))
        return F.transform(kept, lambda g: gram_key(g, n))

    parts = [of(n) for n in range(min_n, max_n + 1)]
    return F.array_distinct(F.concat(*parts))


def keyed(terms: DataFrame, lex: TermLexicon, min_n: int = 2, max_n: int = 4) -> DataFrame:
    """(paragraph_id, pan, eth, key): one row for each candidate of a paragraph, distinct within the row, so no shuffle is needed."""
    return terms.select("paragraph_id", "pan", "eth", F.explode(candidates(F.col("tokens"), lex, min_n, max_n)).alias("key"))


def support(keys: DataFrame) -> DataFrame:
    """(key, n, pooled_n, pan_n, eth_n) in one pass."""
    counted = keys.groupBy("key").agg(F.count("*").alias("pooled_n"), F.sum("pan").alias("pan_n"), F.sum("eth").alias("eth_n"))
    return counted.withColumn("n", F.element_at(F.split("key", r"\|\|"), 1).cast("int"))


def doc_totals(keys: DataFrame) -> DataFrame:
    """(pooled_docs, pan_docs, eth_docs): paragraphs with at least one candidate."""
    docs = keys.groupBy("paragraph_id").agg(F.max("pan").alias("pan"), F.max("eth").alias("eth"))
    return docs.agg(F.count("*").alias("pooled_docs"), F.coalesce(F.sum("pan"), F.lit(0)).alias("pan_docs"), F.coalesce(F.sum("eth"), F.lit(0)).alias("eth_docs"))


def directional(terms: DataFrame) -> DataFrame:
    """(a, b, n): neighbouring words in their order, each occurrence."""
    pairs = terms.select(F.explode(tx.grams(F.col("tokens"), 2)).alias("g"))
    return pairs.groupBy(F.col("g")[0].alias("a"), F.col("g")[1].alias("b")).agg(F.count("*").alias("n"))


def scored(keys: DataFrame, unigrams: DataFrame, min_any: int = 8, method: str = "hybrid") -> DataFrame:
    """support() of keys with at least `min_any` paragraphs in a group, with pmi, rates, gap, score and select_score.

    `unigrams` is support() of single policy terms; other words count as 1e-12, which raises the pmi of pairs with them to its cap.
    """
    top = support(keys).where(F.greatest("pan_n", "eth_n") >= min_any)
    parts = top.select("key", F.explode(F.split(F.element_at(F.split("key", r"\|\|", 2), 2), r"\|\|\|")).alias("t"))
    uni = unigrams.select(F.substr("key", F.lit(4)).alias("t"), F.col("pooled_n").alias("u"))
    docs = doc_totals(keys)
    parts = with_totals(parts.join(uni, "t", "left"), docs)
    logs = parts.groupBy("key").agg(F.sum(F.ln(F.greatest(F.lit(1e-12), F.coalesce("u", F.lit(0)) / F.greatest("pooled_docs", F.lit(1))))).alias("ln_parts"))
    rows = with_totals(top.join(logs, "key"), docs)
    freq, n = F.col("pooled_n").cast("double"), F.col("n")
    pmi = F.when(n <= 1, F.lit(0.0)).otherwise(F.ln(F.greatest(F.lit(1e-12), freq / F.greatest("pooled_docs", F.lit(1)))) - F.col("ln_parts"))
    rows = rows.withColumn("pmi", pmi)
    boost = F.least(F.lit(2.5), F.greatest(F.lit(0.0), F.col("pmi")))
    score = {"freq": F.when(n == 1, 0.55 * freq).otherwise(freq * (1 + 0.18 * (n - 2))), "pmi": F.col("pmi"), "hybrid": freq * (1 + boost) * F.when(n == 1, 0.45).otherwise(1 + 0.22 * (n - 2))}[method]
    rows = rows.withColumns({"pan_rate": F.col("pan_n") / F.greatest("pan_docs", F.lit(1)), "eth_rate": F.col("eth_n") / F.greatest("eth_docs", F.lit(1)), "score": score})
    rows = rows.withColumn("gap", F.col("pan_rate") - F.col("eth_rate"))
    return rows.withColumn("select_score", F.col("score") * (1 + F.least(F.lit(2.0), 12 * F.abs("gap")))).drop("ln_parts", "pooled_docs", "pan_docs", "eth_docs")


def selected(rows: DataFrame, k: int = 90, by: str = "select_score") -> DataFrame:
    """The k best by score rounded to nine places, ties by key."""
    return rows.orderBy(F.desc(F.round(by, 9)), "key").limit(k)


def variants(chosen: DataFrame) -> DataFrame:
    """(key, rep): a longer key goes to the shorter one whose words it holds, if that has at least 3 and 45 % of its count.

    Shortest first, then the largest count, then the key. Of at most as many rows as were selected; two jumps reach the end, as lengths fall from 4 to 2.
    """
    rows = chosen.select("key", "n", (F.col("pan_n") + F.col("eth_n")).alias("cnt"), F.array_sort(F.array_distinct(F.split(F.element_at(F.split("key", r"\|\|", 2), 2), r"\|\|\|"))).alias("words")).where("n >= 2")
    short = F.broadcast(rows.select(F.col("key").alias("rep"), F.col("n").alias("rn"), F.col("cnt").alias("rc"), F.explode("words").alias("w"), F.size("words").alias("rw")))
    long = rows.select("key", "n", "cnt", F.explode("words").alias("w"))
    held = long.join(short, "w").where((F.col("rn") < F.col("n")) & (F.col("rc") >= F.greatest(F.lit(3.0), 0.45 * F.col("cnt"))))
    held = held.groupBy("key", "rep", "rn", "rc", "rw").agg(F.count("*").alias("m")).where("m = rw")
    best = held.groupBy("key").agg(F.min(F.struct("rn", (-F.col("rc")).alias("c"), "rep"))["rep"].alias("rep"))
    second = best.select(F.col("key").alias("rep"), F.col("rep").alias("rep2"))
    jumped = best.join(second, "rep", "left").select("key", F.coalesce("rep2", "rep").alias("rep"))
    return chosen.select("key").join(jumped, "key", "left").select("key", F.coalesce("rep", "key").alias("rep"))


def recounted(keys: DataFrame, merged: DataFrame) -> DataFrame:
    """(paragraph_id, pan, eth, key): keys replaced by what they are merged into, each once a paragraph. `merged` is of bounded size."""
    return keys.join(F.broadcast(merged), "key").select("paragraph_id", "pan", "eth", F.col("rep").alias("key")).distinct()


def label(lex: TermLexicon, canonical: bool = True) -> Column:
    """The name of a key, over columns key, n, words, ab and ba, the counts of either order of a pair."""
    a, b = F.col("words")[0], F.col("words")[1]
    pair = F.concat_ws(" ", *(F.array_sort("words")[i] for i in (0, 1)))
    is_in = lambda w, ws: w.isin(list(ws))
    named = F.element_at(F.create_map(*[F.lit(x) for k, v in lex.labels.items() for x in (" ".join(sorted(k.split())), v)]), pair)
    ab, ba = F.concat_ws(" ", a, b), F.concat_ws(" ", b, a)
    two = (
        F.when(named.isNotNull(), named)
        .when(is_in(a, lex.modifiers) & ~is_in(b, lex.modifiers), ab)
        .when(is_in(b, lex.modifiers) & ~is_in(a, lex.modifiers), ba)
        .when(is_in(a, lex.heads) & ~is_in(b, lex.heads), ba)
        .when(is_in(b, lex.heads) & ~is_in(a, lex.heads), ab)
        .when(F.col("ba") > F.col("ab"), ba)
        .otherwise(ab)
    )
    name = F.when(F.col("n") == 2, two).otherwise(F.array_join("words", " "))
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in lex.canonical.items() for x in kv]), name), name) if canonical else name


def labelled_keys(keys: DataFrame, order: DataFrame, lex: TermLexicon, canonical: bool = True) -> DataFrame:
    """(key, n, label) of distinct keys."""
    rows = keys.select("key").distinct().withColumns({"n": F.element_at(F.split("key", r"\|\|"), 1).cast("int"), "words": F.split(F.element_at(F.split("key", r"\|\|", 2), 2), r"\|\|\|")})
    rows = rows.withColumns({"a": F.col("words")[0], "b": F.get("words", F.lit(1))})
    rows = rows.join(order.select("a", "b", F.col("n").alias("ab")), ["a", "b"], "left").join(order.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("n").alias("ba")), ["a", "b"], "left").fillna(0, ["ab", "ba"])
    return rows.select("key", "n", label(lex, canonical).alias("label"))


def tilt(gap: Column) -> Column:
    return F.when(gap > TILT, "panethnic_tilt").when(gap < -TILT, "ethnic_tilt").otherwise("shared")


def nodes(recount: DataFrame, labels: DataFrame, docs: DataFrame, min_any: int = 8) -> DataFrame:
    """(node, node_key, ngram_n, pan_n, eth_n, pooled_n, pan_rate, eth_rate, gap_pan_minus_eth, selection_score, tilt): keys of one label added up."""
    counts = recount.groupBy("key").agg(F.sum("pan").alias("pan_n"), F.sum("eth").alias("eth_n")).where(F.greatest("pan_n", "eth_n") >= min_any)
    by = counts.join(labels, "key").groupBy(F.col("label").alias("node")).agg(F.array_join(F.array_sort(F.collect_set("key")), ";;").alias("node_key"), F.min("n").alias("ngram_n"), F.sum("pan_n").alias("pan_n"), F.sum("eth_n").alias("eth_n"))
    rows = with_totals(by, docs).withColumns({"pooled_n": F.col("pan_n") + F.col("eth_n"), "pan_rate": F.col("pan_n") / F.greatest("pan_docs", F.lit(1)), "eth_rate": F.col("eth_n") / F.greatest("eth_docs", F.lit(1))})
    rows = rows.withColumn("gap_pan_minus_eth", F.col("pan_rate") - F.col("eth_rate"))
    rows = rows.withColumns({"selection_score": F.col("pooled_n") * (1 + F.least(F.lit(2.0), 12 * F.abs("gap_pan_minus_eth"))), "tilt": tilt(F.col("gap_pan_minus_eth"))})
    return rows.drop("pooled_docs", "pan_docs", "eth_docs").orderBy(F.desc(F.round("selection_score", 6)), "node")


def single_hub_nodes(recount: DataFrame, chosen: DataFrame, labels: DataFrame, docs: DataFrame, least: int = 8) -> DataFrame:
    """(node, node_key, ngram_n, pan_n, pan_rate, selection_score) of one group, a row for each representative, by score and recount.

    `chosen` has the scores that the keys were selected by; representatives under `least` paragraphs after the recount are left out.
    Keys of one label stay apart.
    """
    counts = recount.groupBy("key").agg(F.count("*").alias("pan_n")).where(F.col("pan_n") >= least)
    rows = counts.join(chosen.select("key", F.col("score").alias("selection_score")), "key").join(labels, "key")
    rows = with_totals(rows, docs.select("pan_docs")).select(F.col("label").alias("node"), F.col("key").alias("node_key"), F.col("n").alias("ngram_n"), "pan_n", (F.col("pan_n") / F.greatest("pan_docs", F.lit(1))).alias("pan_rate"), "selection_score")
    return rows.orderBy(F.desc(F.round("selection_score", 9)), F.desc("pan_n"), "node_key")


def single_hub_edges(recount: DataFrame, node: DataFrame, max_edges: int = 140, least: int = 3) -> DataFrame:
    """(from_node, to_node, edge_type, edge_group, weight_n): the hub's edges, and the strongest pairs of representatives, counted by key and named by label; ties by key."""
    own = F.broadcast(node.select("node_key", "node"))  # at most as many rows as keys were selected
    names = node.select(F.col("node_key").alias("label"), F.col("node_key").alias("node"))
    pairs = pair_counts(recount, node.select(F.col("node_key").alias("key"), F.col("node_key").alias("label")), names, least)
    top = pairs.orderBy(F.desc("weight_n"), "from_node", "to_node").limit(max_edges)
    top = top.join(own.toDF("from_node", "a"), "from_node").join(own.toDF("to_node", "b"), "to_node")
    hub = node.select(F.lit("panethnic_hub").alias("from_node"), F.col("node").alias("to_node"), F.lit("hub_term").alias("edge_type"), F.lit("Panethnic Hub").alias("edge_group"), F.col("pan_n").alias("weight_n"))
    return hub.unionByName(top.select(F.col("a").alias("from_node"), F.col("b").alias("to_node"), F.lit("term_term").alias("edge_type"), F.lit("Term-Term").alias("edge_group"), "weight_n"))


def length_histogram(node: DataFrame) -> DataFrame:
    """(ngram_n, n_nodes)."""
    return node.groupBy("ngram_n").agg(F.count("*").alias("n_nodes"))


def pair_counts(recount: DataFrame, labels: DataFrame, node: DataFrame, least: int = 3) -> DataFrame:
    """(from_node, to_node, weight_n), from < to: paragraphs that hold both labels. The self-join is on the paragraph; a paragraph holds at most the selected labels."""
    rows = recount.join(F.broadcast(labels), "key").join(F.broadcast(node.select(F.col("node").alias("label"))), "label", "left_semi").select("paragraph_id", "label").distinct()
    each = rows.groupBy("paragraph_id").agg(F.array_sort(F.collect_list("label")).alias("ls")).where(F.size("ls") > 1)
    pairs = each.select(F.posexplode("ls").alias("i", "from_node"), "ls").select("from_node", F.explode(F.slice("ls", F.col("i") + 2, F.size("ls"))).alias("to_node"))
    return pairs.groupBy("from_node", "to_node").agg(F.count("*").alias("weight_n")).where(F.col("weight_n") >= least)


def hub_edges(node: DataFrame) -> DataFrame:
    """Edges from the two groups to each node, with counts and rates."""
    one = lambda hub, n, r, g: node.select(F.lit(hub).alias("from_node"), F.col("node").alias("to_node"), F.lit("hub_term").alias("edge_type"), F.lit(g).alias("edge_group"), F.col(n).cast("long").alias("weight_n"), F.col(r).alias("weight_rate"))
    return one("panethnic_hub", "pan_n", "pan_rate", "Panethnic Hub").unionByName(one("ethnic_hub", "eth_n", "eth_rate", "Ethnic Hub"))


def edges(node: DataFrame, pairs: DataFrame, max_edges: int = 220) -> DataFrame:
    """hub_edges() and the strongest pairs, ties by name; pairs have no rate."""
    top = pairs.orderBy(F.desc("weight_n"), "from_node", "to_node").limit(max_edges)
    return hub_edges(node).unionByName(top.select("from_node", "to_node", F.lit("term_term").alias("edge_type"), F.lit("Term-Term").alias("edge_group"), "weight_n", F.lit(None).cast("double").alias("weight_rate")))


def log_odds(words: DataFrame, pan_total: Column, eth_total: Column) -> DataFrame:
    """Adds log_odds_pan_vs_eth, with half a case added to each cell."""
    a, b = F.col("pan_n"), F.col("eth_n")
    return words.withColumn("log_odds_pan_vs_eth", F.ln(((a + 0.5) * (eth_total - b + 0.5)) / ((b + 0.5) * (pan_total - a + 0.5))))


def choose(node: DataFrame, most: int = 28, per_tilt: int = 6) -> DataFrame:
    """(node): up to `per_tilt` nodes of each tilt by count and gap, filled up by weighted count; all if there are no more than `most`."""
    from pyspark.sql import Window as W

    gap = F.abs("gap_pan_minus_eth")
    rank = F.row_number().over(W.partitionBy("tilt").orderBy(F.desc("pooled_n"), F.desc(F.round(gap, 9)), "node"))
    rows = node.withColumn("first", (rank <= per_tilt).cast("int"))
    return rows.orderBy(F.desc("first"), F.desc(F.round(F.col("pooled_n") * (1 + 5 * gap), 9)), F.desc("pooled_n"), "node").limit(most).select("node", "tilt", "pooled_n")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
