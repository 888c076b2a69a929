import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import quality as Q

PANEL = "paragraph_id string, file_name string, paragraph_text string, paragraph_text_norm string"
TEXTS = {
    "prose": ["The school board met with the parents of the county and postponed the vote until May.\nIt was the second such delay in a year.", "OF THE 742 GUESTS AT PIEDRAMORA, 238 CAME\nIN DECEMBER AND 24 AFTER 6 P.M.,\nAGAINST 508 IN 1980.", "The choir came from Granby Locks, Brackwater, Solana\nHeights and Valdera and sang for an hour.", "En mayo de 1974 la clínica de Altavela\nanunció las consultas para las madres del barrio."],
    "list": ["• 14 lemonade,\n• 10 drum sticks,\n• 28 extension cords;", "Masking tape ......... 29\nGarden hose ...... 30\nFlower pots ....... 13", "Dec 8: Name tags, Merrowby, 8 am\nJan 12: Bunting, Solana Heights, 2 pm", "1: Puntarroja, Valdera\n2: Windover, Arroyo Gris\n3: Santolla, Dunmere", "Page 9  Harvest Road Newsletter\n+ 5 rope,\n+ 6 chalk;\n+ 7 bunting"],
    "tabular": ["Copies  Adults  Spring\nGranby Locks  24%  10.3\nBrackwater  4,393  25.2\nVado Hondo  -  n.a.", "1974   49.7   581\n1975   578   44%\n1976   43%   77.9", "Miles; Change; Adults\nValdera; 2,825; 78%\nMerrowby; -; n.a.\nElmstead; 76%; 94%"],
    "junk": ["fxvf rkzc ffghx bntcpwm kksfptp wc\nmfgpkx cvg hg gwhkgl rhtmv", "■n «=«] [Jv■ <» lsnb7\n|¦» •={= t J-[,- '«_`=", "0O0t 8B0 0O0 Â¬ ~~ ï¿½r\n§§ ï¿½r Ã©r Ã±ot Ã© 0O0"],
    "furniture": ["The Old Bridge Newsletter, January 1966", "Page 12  Harvest Road Newsletter", "~ 12 ~", "xiv", "TOWN CRIER - JULY 1970", "Windover Circle Journal  Vol. 17 No. 10"],
}


def frame(spark):
    rows = [(f"{k}{i}", "f", t, " ".join(t.lower().split())) for k, ts in TEXTS.items() for i, t in enumerate(ts)]
    rows += [(f"more{i}", "f", f"{TEXTS['prose'][0]} And so it went on for the {i}th time.", None) for i in range(30)]
    return spark.createDataFrame(rows, PANEL)


def test_kinds(spark):
    got = {r.paragraph_id: r.text_kind for r in Q.with_text_kind(frame(spark)).collect()}
    assert {p: k for p, k in got.items() if not p.startswith(k) and not p.startswith("more")} == {}
    assert all(k == "prose" for p, k in got.items() if p.startswith("more"))


def test_found_leaves_prose_and_empty_out(spark):
    extra = spark.createDataFrame([("null", "f", None, None), ("empty", "f", "", ""), (None, "f", "~ 12 ~", "~ 12 ~"), ("list0", "f", TEXTS["list"][0], TEXTS["list"][0]), ("long", "f", TEXTS["prose"][0] * 3000, None)], PANEL)
    panel = frame(spark).unionByName(extra).withColumns({"pattern": F.lit(7), "text_kind": F.lit("x"), "n_words": F.lit(1)})
    got = [r.paragraph_id for r in Q.not_prose(panel).collect()]
    assert len(got) == len(set(got)) == sum(len(v) for k, v in TEXTS.items() if k != "prose")
    kinds = {r.paragraph_id: r.text_kind for r in Q.with_text_kind(panel).collect()}
    assert kinds["null"] == kinds["empty"] == "empty" and kinds["long"] == "prose"
    assert Q.not_prose(panel.where("false")).count() == 0


def test_statistics_of_known_text(spark):
    row = Q.with_statistics(spark.createDataFrame([("p", "f", "The cat sat.\nOn 12 mats", "the cat sat. on 12 mats"), ("n", "f", None, None)], PANEL)).orderBy(F.desc("paragraph_id")).collect()
    p, n = row
    assert (p.n_words, p.n_tokens, p.n_lines) == (5, 6, 2) and p.mean_word_length == pytest.approx(15 / 5) and p.end_share == 0.5 and p.common_share == 0.4 and p.digit_share == pytest.approx(2 / 23)
    assert (n.n_words, n.n_lines, n.common_share, n.end_share) == (0, 0, 0, 0)


def test_accuracies_are_learned_from_agreements():
    rng = np.random.default_rng(5)
    truth = rng.choice(5, size=6000, p=[0.6, 0.1, 0.1, 0.1, 0.1])
    kinds = [0, 0, 0, 1, 1, 2, 2, 3, 3, 4, 4]
    rate = [0.9, 0.7, 0.8, 0.9, 0.6, 0.9, 0.7, 0.9, 0.8, 0.9, 0.6]
    x = np.stack([np.where(truth == k, rng.random(6000) < r, rng.random(6000) < 0.04) for k, r in zip(kinds, rate, strict=True)], axis=1).astype(int)
    patterns, inverse, counts = np.unique(x, axis=0, return_inverse=True, return_counts=True)
    post, learned = Q.learn(patterns, counts, kinds)
    assert (post.argmax(axis=1)[inverse.ravel()] == truth).mean() > 0.93
    assert all(abs(learned[i, k] - r) < 0.1 for i, (k, r) in enumerate(zip(kinds, rate, strict=True)))


def test_issues_beside_their_keep_rate(spark):
    issues = spark.createDataFrame([(1, "f", 80.0), (1, "f", 80.0), (2, "f", None)], "batch_no int, file_name string, keep_rate_pct double")
    row = Q.issue_text_kinds(frame(spark), issues).first()
    assert row.n_paragraphs == frame(spark).count() and 0.5 < row.prose_share < 0.8 and row.keep_rate_pct == 80.0


FULL_OF_FUNCTION_WORDS = {
    "items": "* Friends of the Library\n* Sons of the Valley\n* Museum of the Coast",
    "contents": "Report of the Board ..... 4\nLetter to the Editor ..... 6\nNotes from the Valley ..... 9",
    "rows": "Cost of the hall  14  20\nRent of the van  9  n.a.\nPay for the band  30  41",
    "absent": "Cost of the hall  n.a.  n.a.\nRent of the van  n.a.  n.a.\nPay for the band  n.a.  n.a.",
    "names": "Sons of, Valley, Coast\nEl Sol, La Luna\nThe Choir of the Hill\nThe Band of the Coast\nThe Club of the Bay",
    "capitals": "OF THE 742 GUESTS AT PIEDRAMORA,\nTHE MOST CAME IN MAY AND THE REST\nCAME TO THE FAIR IN JUNE.",
}


def test_statistics_don_t_depend_on_function_words(spark):
    rows = spark.createDataFrame([(k, "f", t, " ".join(t.lower().split())) for k, t in FULL_OF_FUNCTION_WORDS.items()], PANEL)
    got = {r.paragraph_id: r for r in Q.with_statistics(rows).withColumns({n: when for n, _, when in Q.labelling_functions()}).collect()}
    assert all(r.common_share >= 0.14 and r.n_lines >= 3 for r in got.values())
    assert got["items"].item_share == got["contents"].item_share == 1 and got["items"].item_lines and got["contents"].item_lines
    assert not got["items"].lower_case_run and not got["capitals"].lower_case_run and got["capitals"].lower_words == 0
    assert got["rows"].row_share == got["absent"].row_share == 1 and got["rows"].figure_rows and got["absent"].figure_rows
    assert got["rows"].cell_share == got["absent"].cell_share == 6 / 18
    assert got["names"].names_share == 0.4
