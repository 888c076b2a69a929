import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import subjects as S

PANEL = "paragraph_id string, file_name string, paragraph_text string"
MATTER = {
    "law": ["the court heard the appeal on bail", "a judge signed the warrant for arrest"],
    "sport": ["the striker scored a late goal", "runners crossed the marathon line"],
    "health": ["nurses gave the vaccine to infants", "the clinic measured blood pressure"],
}
FILLER = ["The parade came down the hill in June.", "Guests brought lanterns to the hall.", "Nobody counted the chairs by the door.", "A goal of the fair was joy."]


def corpus(n, seed=0, wrong=0.03):
    rnd = random.Random(seed)
    rows, labels, truth = [], [], {}
    for i in range(n):
        themes = [t for t in MATTER if rnd.random() < 0.3]
        sentences = [rnd.choice(FILLER) for _ in range(rnd.randint(1, 3))] + [rnd.choice(MATTER[t]).capitalize() + f" in {rnd.choice(['May', 'July'])}." for t in themes]
        rnd.shuffle(sentences)
        rows.append((f"p{i}", f"herald00_19{60 + i % 20}_05.pdf", " ".join(sentences)))
        truth[f"p{i}"] = set(themes)
        said = themes if rnd.random() > wrong else [rnd.choice(list(MATTER))]
        labels += [(f"p{i}", t) for t in said or ["none"]]
    return rows, labels, truth


def test_held_out_accuracy(spark):
    rows, labels, truth = corpus(900)
    panel = spark.createDataFrame(rows, PANEL)
    chain = S.train(panel, spark.createDataFrame([x for x in labels if int(x[0][1:]) < 600], "paragraph_id string, theme string"), spark.createDataFrame([(t,) for t in MATTER], "theme string"))
    got = {r.paragraph_id: set(r.subjects) for r in S.subjects_of(panel, chain).collect()}
    held = [f"p{i}" for i in range(600, 900)]
    assert sum(got[p] == truth[p] for p in held) / len(held) > 0.97


def test_batch_scores_equal_single_ones():
    rows, labels, truth = corpus(300)
    chain = S.fit([(S.features(t, f), truth[p]) for p, f, t in rows], list(MATTER))
    texts = [t for _, _, t in rows[:40]] + ["", None, "Ünïcode 12 words?! no\nend"]
    sources = [f for _, f, _ in rows[:40]] + [None, None, ""]
    single = np.stack([chain.bias + chain.weights[[chain.index[f] for f in S.features(t, s) if f in chain.index]].sum(axis=0) for t, s in zip(texts, sources)])
    assert np.allclose(chain.matrix(texts, sources), single)


def test_beam_search_finds_the_best_combination():
    rnd = np.random.default_rng(3)
    k = 4
    chain = S.Chain(list("abcd"), {}, np.zeros((0, k)), np.zeros(k), np.tril(rnd.normal(size=(k, k)) * 2, -1), np.ones(k), np.zeros(k))
    z = rnd.normal(size=(50, k))
    found, p = chain.decode(z, width=16)

    def prob(row, y):
        q = 1 / (1 + np.exp(-(row + chain.links @ y)))
        return np.prod(np.where(y == 1, q, 1 - q))

    for row, y, value in zip(z, found, p, strict=True):
        best = max(prob(row, np.array([m >> i & 1 for i in range(k)], float)) for m in range(16))
        assert value == pytest.approx(best) and prob(row, y) == pytest.approx(best)


def test_misread_and_cut_words_are_the_same_terms():
    assert S.terms("The c1inic meas-\nured blo|od pres5ure") == S.terms("the clinic measured blood pressure")


def test_nulls_repeats_clashes_and_no_labels(spark):
    rows, labels, truth = corpus(250)
    panel = spark.createDataFrame([*rows, rows[0], ("null", None, None), ("empty", "x", ""), (None, "x", "the court heard the appeal on bail"), ("long", "x", "The striker scored a late goal. " * 5000)], PANEL)
    panel = panel.withColumns({"subjects": F.lit(1), "confidence": F.lit(2), "theme": F.lit("law")})
    themes = spark.createDataFrame([("law",), ("sport",), ("health",), ("health",), (None,)], "theme string")
    chain = S.train(panel, spark.createDataFrame([*labels, ("gone", "law"), ("p1", None)], "paragraph_id string, theme string"), themes)
    found = S.subjects_of(panel, chain)
    got = {r.paragraph_id: r.subjects for r in found.collect()}
    assert len(got) == 253 and got["null"] == [] and got["empty"] == [] and got["long"] == ["sport"]
    shares = {r.theme: r.n_paragraphs for r in S.subject_shares(found).collect()}
    assert shares["sport"] == sum("sport" in x for x in got.values()) and shares["none"] == sum(not x for x in got.values())
    nothing = S.train(panel, spark.createDataFrame([], "paragraph_id string, theme string"), themes)
    assert all(not r.subjects for r in S.subjects_of(panel, nothing).collect())
    assert S.subjects_of(panel.where("false"), chain).count() == 0


def test_shares_are_those_of_the_found_rows(spark, tmp_path):
    from paperloom.llm import queries

    rows, labels, _ = corpus(300)
    lists = [(f"list{i}", "herald00_1960_05.pdf", "• 14 striker scored a late goal,\n• 10 striker scored a late goal,\n• 28 striker scored a late goal;") for i in range(10)]
    panel = spark.createDataFrame(rows + lists, PANEL).withColumn("paragraph_text_norm", F.lower("paragraph_text"))
    marks = spark.createDataFrame(labels, "paragraph_id string, theme string")
    themes = spark.createDataFrame([(t,) for t in MATTER], "theme string")
    for name, df in (("paragraph_panel", panel), ("subject_labels", marks), ("paragraph_theme_prevalence_by_group", themes)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    raw = {r.paragraph_id: r.subjects for r in S.subjects_of(panel, S.train(panel, marks, themes)).collect()}
    found = [tuple(r) for r in queries.p2_found(spark, str(tmp_path)).collect()]
    assert any(raw[p] for p, _, _ in lists) and not any(p.startswith("list") for p, _ in found)
    shares = {r.theme: r for r in queries.p2_shares(spark, str(tmp_path)).collect()}
    assert {t: shares[t].n_paragraphs for t in MATTER} == {t: sum(x == t for _, x in found) for t in MATTER}
    assert shares["none"].n_paragraphs == 310 - len({p for p, _ in found}) and shares["law"].share == pytest.approx(shares["law"].n_paragraphs / 310)
