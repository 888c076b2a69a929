import math

import pytest
from pyspark.sql import functions as F

from paperloom.functions import text as tx
from paperloom.lexicon import TermLexicon
from paperloom.operators import embed, graph, network

LEX = TermLexicon()
EDGE = "from_node string, to_node string, weight_n long"


def test_tokens_are_made_normal(spark):
    words = {"workers": "workers", "agencies": "agency", "departments": "department", "policies": "policy", "businesses": "business", "prisons": "prison", "children's": "children"}
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", tx.normal_token(F.col("w"), LEX).alias("n")).collect()
    assert {r.w: r.n for r in rows} == words


def test_candidates_of_a_sequence(spark):
    row = spark.createDataFrame([("The civil rights of farm workers",), (None,)], "t string").select(tx.term_sequence(F.col("t"), LEX).alias("s"))
    got = row.select("s", network.candidates(F.col("s"), LEX, 2, 4).alias("k")).collect()
    assert got[0].s == ["civil", "rights", "farm", "workers"] and got[1].k == []
    assert set(got[0].k) == {"2||civil|||rights", "2||farm|||rights", "2||farm|||workers", "3||civil|||rights|||farm", "3||rights|||farm|||workers", "4||civil|||rights|||farm|||workers"}


def test_scores(spark):
    keys = spark.createDataFrame([(f"d{i}", 1, 0, "2||civil|||rights") for i in range(10)] + [(f"d{i}", 1, 0, "2||other|||health") for i in range(10, 100)], "paragraph_id string, pan int, eth int, key string")
    uni = spark.createDataFrame([("1||civil", 20), ("1||rights", 25)], "key string, pooled_n long")
    row = network.scored(keys, uni, 8).where("key = '2||civil|||rights'").first()
    assert row.pmi == pytest.approx(math.log(2)) and row.score == pytest.approx(16.931472)
    assert network.scored(keys, uni, 8).where("key like '%health'").first().score == pytest.approx(90 * 3.5)


@pytest.mark.parametrize(("count", "rep"), [(10, "2||a|||b"), (8, "3||a|||b|||c")])
def test_variants(spark, count, rep):
    rows = spark.createDataFrame([("2||a|||b", 2, count, 0), ("3||a|||b|||c", 3, 20, 0)], "key string, n int, pan_n long, eth_n long")
    assert {r.key: r.rep for r in network.variants(rows).collect()}["3||a|||b|||c"] == rep


def test_names_of_keys(spark):
    keys = spark.createDataFrame([("2||department|||labor",), ("2||civil|||rights",), ("2||equal|||opportunity",), ("2||aaaa|||bbbb",), ("3||a|||b|||c",)], "key string")
    order = spark.createDataFrame([("bbbb", "aaaa", 3), ("aaaa", "bbbb", 1)], "a string, b string, n long")
    assert {r.label for r in network.labelled_keys(keys, order, LEX).collect()} == {"labor department", "civil rights", "equal opportunity", "bbbb aaaa", "a b c"}


def test_tilt_is_strict(spark):
    rows = spark.createDataFrame([(0.01,), (0.0101,), (-0.0101,)], "g double").select(network.tilt(F.col("g")).alias("t")).collect()
    assert [r.t for r in rows] == ["shared", "panethnic_tilt", "ethnic_tilt"]


def test_graph_adds_up_both_directions_and_leaves_nulls_out(spark):
    g = graph.undirected(spark.createDataFrame([("b", "a", 2), ("a", "b", 3), ("a", None, 1), ("c", "a", None)], EDGE))
    assert [tuple(r) for r in g.collect()] == [("a", "b", 5)]


def test_components_of_chains(spark):
    chain = [(f"n{i:02d}", f"n{i + 1:02d}", 1) for i in range(40) if i != 20]
    got = {r.node: r.component for r in graph.components(graph.undirected(spark.createDataFrame(chain, EDGE))).collect()}
    assert len(got) == 41 and {got[f"n{i:02d}"] for i in range(21)} == {"n00"} and {got[f"n{i:02d}"] for i in range(21, 41)} == {"n21"}
    assert graph.components(graph.undirected(spark.createDataFrame([], EDGE))).count() == 0


def test_louvain_finds_cliques_and_covers_all_nodes(spark):
    clique = lambda names: [(a, b, 5) for a in names for b in names if a < b]
    got = {r.node: r.community for r in graph.louvain(graph.undirected(spark.createDataFrame(clique("abcd") + clique("wxyz") + [("a", "w", 1)], EDGE))).collect()}
    assert len(got) == 8 and len({got[n] for n in "abcd"}) == 1 and len({got[n] for n in "wxyz"}) == 1 and got["a"] != got["w"]
    assert graph.louvain(graph.undirected(spark.createDataFrame([], EDGE))).count() == 0


def test_windows_stay_within_a_document(spark):
    rows = spark.createDataFrame([("d", list("abc")), ("e", ["a"]), ("f", [])], "k string, tokens array<string>")
    assert {(r.a, r.b, r.n) for r in embed.window_pairs(rows, "k", width=1).collect()} == {("a", "b", 1), ("b", "c", 1)}
    assert embed.windows(rows, "k", k=4).count() == 0


def test_nearest_vectors_leave_the_query_out(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 1.0]), (3, [0.0, 0.0])], "vec_id long, embedding array<float>")
    assert [r.vec_id for r in embed.neighbours(v, v.where("vec_id = 0"), 2).orderBy("rank").collect()] == [1, 2]


def test_transform_matrix_recovers_a_linear_map(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    a, x = np.array([[2.0, 1.0], [0.0, -1.0]]), rng.normal(size=(50, 2))
    contexts = spark.createDataFrame([(f"w{i}", 10, r.tolist()) for i, r in enumerate(x)], "word string, n long, context array<double>")
    vectors = spark.createDataFrame([(f"w{i}", (a @ r).tolist()) for i, r in enumerate(x)], "word string, vector array<double>")
    got = np.array([r["values"] for r in embed.transform_matrix(contexts, vectors).orderBy("row").collect()])
    assert np.allclose(got, a, atol=1e-5)


def test_contexts_are_means_of_neighbours(spark):
    tokens = spark.createDataFrame([("d", ["a", "b", "c"])], "k string, tokens array<string>")
    vectors = spark.createDataFrame([("a", [1.0]), ("c", [3.0])], "word string, vector array<double>")
    got = {r.word: r.context for r in embed.around(tokens, "k", vectors, width=1).collect()}
    assert got == {"b": [2.0]}


def test_contrast_tells_real_groups_from_random_ones(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    rows = [(i, i % 2, (rng.normal(size=3) * 0.1 + ([1, 0, 0.5] if i % 2 else [0, 1, 0.5])).tolist()) for i in range(60)]
    v = spark.createDataFrame(rows, "vec_id long, g int, embedding array<double>")
    r = {x.vec_id: x for x in embed.contrast_neighbours(v, "g", v.where("vec_id < 2"), permutations=20).collect()}
    assert r[1].ratio > 1.2 > 0.9 > r[0].ratio and r[1].p <= 0.1 and r[0].std_error < 0.2
    assert embed.contrast_neighbours(v.where("false"), "g", v).count() == 0


def brute_knn(rows, queries, k, ties):
    import numpy as np

    out = set()
    unit = {i: np.array(x) / np.linalg.norm(x) if any(x) else None for i, x in rows}
    for q in queries:
        s = sorted(((-round(float(unit[q] @ u), 12), i) for i, u in unit.items() if i != q and u is not None))
        bar = s[min(k, len(s)) - 1][0]
        out |= {(q, i) for n, (v, i) in enumerate(s) if (v <= bar if ties else n < k)}
    return out


@pytest.mark.parametrize("ties", [False, True])
def test_nearest_vectors_against_brute_force_with_copies_and_blocks(spark, monkeypatch, ties):
    import random

    rnd = random.Random(8)
    rows = [(i, [float(rnd.randint(-2, 2)) for _ in range(3)]) for i in range(150)]
    rows = [(i, [1.0, 2.0, 1.0] if i % 3 == 0 else x) for i, x in rows] + [(200, [0.0, 0.0, 0.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    queries = [i for i, x in rows if i % 20 == 0 and any(x)][:6]
    q = v.where(F.col("vec_id").isin(queries))
    want = brute_knn(rows, queries, 5, ties)
    for block, chunk in ((20_000, 512), (2, 7)):
        monkeypatch.setattr(embed, "MAX_QUERIES", block)
        monkeypatch.setattr(embed, "CHUNK", chunk)
        assert {(r.query_id, r.vec_id) for r in embed.neighbours(v, q, 5, ties).collect()} == want
    assert embed.neighbours(v, v.where("false")).count() == 0 and embed.neighbours(v.where("false"), q).count() == 0


def test_resamples_add_up_over_tasks(spark):
    import numpy as np

    rows = [(i, i % 2, [float(i), 1.0]) for i in range(40)]
    v = spark.createDataFrame(rows, "vec_id long, g int, embedding array<double>")
    got = {(r.g, r.boot): (r.n, r.embedding) for r in embed.bootstrap_means(v.repartition(5), "g", boots=3).collect()}
    for g in (0, 1):
        ids = np.array([i for i, x, _ in rows if x == g])
        for boot in (1, 2, 3):
            w = embed.poisson(ids, boot, 42)
            assert got[g, boot][0] == w.sum() and got[g, boot][1] == pytest.approx([(w * ids).sum() / w.sum(), 1.0])
    draws = embed.poisson(np.arange(100_000), 1, 42)
    assert abs(draws.mean() - 1) < 0.02 and abs((draws == 0).mean() - 0.3679) < 0.01


def test_contexts_their_neighbours_and_examples(spark):
    from paperloom.operators import contexts

    tokens = spark.createDataFrame([("d1", "x", ["a", "key", "b", "c"]), ("d2", "y", ["key", "c", "d", "key"]), ("d3", "x", ["a", "b"])], "k string, g string, tokens array<string>")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.2]), ("c", [0.0, 1.0]), ("far", [-1.0, 0.0])], "word string, vector array<double>")
    found = contexts.contexts(tokens, "k", "key", ("g",), width=1)
    assert sorted((r.g, r.context) for r in found.collect()) == [("x", ["a", "b"]), ("y", ["c"]), ("y", ["d"])]
    assert {r.word for r in contexts.vocabulary(found, "key").collect()} == set("abcd")
    turned = spark.createDataFrame([(0, [0.0, 1.0]), (1, [1.0, 0.0])], "row int, values array<double>")
    plain, swapped = ({r.g: r.embedding for r in contexts.embedded(found, vectors, m, ("g",)).collect()} for m in (None, turned))
    assert plain == {"x": [1.0, 0.1], "y": [0.0, 1.0]} and swapped == {"x": [0.1, 1.0], "y": [1.0, 0.0]}
    rows = contexts.embedded(found, vectors, None, ("g",))
    near = contexts.nearest_words(rows, vectors, ("g",), boots=30, most=2).collect()
    assert {r.word for r in near if r.g == "x"} == {"a", "b"} and all(r.low <= r.estimate <= r.high for r in near)
    assert contexts.in_both(spark.createDataFrame([("x", "a"), ("y", "a"), ("y", "b")], "g string, word string"), "g").count() == 2
    assert [(r.g, r.context) for r in contexts.examples(found, rows, ("g",), 1).orderBy("g").collect()] == [("x", "a b"), ("y", "c")]
    assert contexts.nearest_words(rows.where("false"), vectors, ("g",)).count() == 0


def test_explicit_vectors_count_the_frequent_words_nearby(spark):
    tokens = spark.createDataFrame([("d", ["a", "b", "a", "c"]), ("e", ["a", "b", "x"])], "k string, tokens array<string>")
    got = {r.word: r.vector for r in embed.count_vectors(tokens, "k", dims=2, width=1, least=2).collect()}
    assert got == {"a": pytest.approx([0.0, math.log(4)]), "b": pytest.approx([math.log(4), 0.0])}
    assert embed.count_vectors(tokens.where("false"), "k").count() == 0


def test_rows_are_numbered_over_partitions(spark):
    rows = spark.range(100).selectExpr("(id * 37) % 100 as x").repartition(7)
    assert [(r.x, r.i) for r in graph.numbered(rows, F.desc("x"), "i").orderBy("i").collect()] == [(99 - i, i + 1) for i in range(100)]
    assert graph.numbered(rows.where("false"), "x", "i").count() == 0


def test_lone_nodes_seeds_and_the_last_of_repeated_edges(spark):
    edges = spark.createDataFrame([("a", "b", 5), ("b", "c", 5)], EDGE)
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("y",), ("z",)], "node string")
    got = {r.node: r.community for r in graph.louvain(graph.undirected(edges), seed=3, nodes=nodes).collect()}
    assert len(got) == 5 and len({got["y"], got["z"], got["a"]}) == 3
    assert {r.node for r in graph.louvain(graph.undirected(edges.where("false")), nodes=nodes).collect()} == set("abcyz")
    last = graph.last_written(spark.createDataFrame([("a", "b", 5, 1), ("b", "a", 2, 2), ("a", None, 1, 1)], f"{EDGE}, batch_no int"), "batch_no")
    assert [tuple(r) for r in last.collect()] == [("a", "b", 2)]


def test_scaling_of_equal_and_spread_values(spark):
    size = lambda *xs: [r["size"] for r in graph.scaled(spark.createDataFrame([(x,) for x in xs], "v double"), "v", "size", 2.0, 6.0).orderBy("v").collect()]
    assert size(1.0, 2.0, 3.0) == [2.0, 4.0, 6.0] and size(5.0, 5.0) == [4.0, 4.0]


def test_nearest_vertex(spark):
    p = spark.createDataFrame([("a", 0.0, 0.0), ("b", 3.0, 4.0), ("c", 3.0, 5.0)], "node string, x double, y double")
    assert {r.node: r.distance for r in graph.nearest_vertex(p).collect()} == {"a": 5.0, "b": 1.0, "c": 1.0}
