from pyspark.sql import functions as F

from paperloom.llm import leakage

WORDS = [f"word{i}" for i in range(40)]
ITEM = "item_id long, passage string"
DOC = "doc_id long, text string"


def found(spark, docs, items, **kw):
    return {(r.doc_id, r.item_id) for r in leakage.leaked(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM), **kw).collect()}


DOCS = [
    (1, "x " + " ".join(WORDS[3:15]) + " y"),
    (2, "x " + " ".join(WORDS[3:14]) + " y"),
    (3, " ".join(WORDS[:6]) + " gap " + " ".join(WORDS[6:12])),
    (4, " ".join(w.upper() for w in WORDS[:12])),
    (5, "wo-\nrd0 w­ord1 WÓRD2 word's3 " + " ".join(WORDS[4:12])),
    (6, None),
    (7, ""),
    (8, " ".join(WORDS[20:26])),
    (9, " ".join(WORDS[26:32])),
    (1, "again"),
]


def test_cases(spark):
    items = [(100, " ".join(WORDS)), (100, " ".join(WORDS)), (101, "too short"), (102, None), (103, "wo rd0 word1 word2 words3 " + " ".join(WORDS[4:11]))]
    got = found(spark, DOCS, items)
    assert (1, 100) in got and (4, 100) in got and not {d for d, _ in got} & {2, 3, 6, 7, 8, 9}
    docs = [(5, DOCS[4][1])]
    assert found(spark, docs, [(1, "word0 word1 word2 words3 " + " ".join(WORDS[4:12]))]) == {(5, 1)}
    assert found(spark, docs, [(1, "rd0 word1 word2 words3 " + " ".join(WORDS[4:12]))]) == set()


def test_join_beyond_the_bound_gives_the_same(spark):
    items = [(i, " ".join(WORDS[i : i + 20])) for i in range(20)]
    assert found(spark, DOCS, items) == found(spark, DOCS, items, max_broadcast_words=1) != set()


def test_empty_tables_and_clashing_columns(spark):
    assert found(spark, [], [(1, " ".join(WORDS))]) == set() and found(spark, DOCS, []) == set()
    docs = spark.createDataFrame(DOCS, DOC).withColumns({"item_id": F.lit(1), "word": F.lit("w"), "passage": F.lit("p")})
    assert leakage.leaked(docs, spark.createDataFrame([(7, " ".join(WORDS))], ITEM).withColumn("doc_id", F.lit(3))).count() == 2


def test_removal_cuts_the_stretch_only(spark):
    text = "Before it. " + " ".join(WORDS[:14]).title() + "! After it."
    rows = [(1, text), (2, "nothing here"), (3, None), (4, text + " " + text)]
    got = {r.doc_id: (r.clean_text, r.n_cut) for r in leakage.without_leaks(spark.createDataFrame(rows, DOC), spark.createDataFrame([(1, " ".join(WORDS))], ITEM)).collect()}
    assert got[1] == ("Before it. ! After it.", 1) and got[2] == ("nothing here", 0) and got[3] == (None, 0) and got[4][1] == 2


def test_removal_beyond_the_bound_gives_the_same(spark):
    text = "Before it. " + " ".join(WORDS[:14]).title() + "! After it. " + " ".join(WORDS[20:33])
    rows = [(1, text), (2, "nothing here"), (3, None), (4, text + " " + text), (1, text), (5, text), (None, text), (6, ""), (7, "wo-\nrd0 " + " ".join(WORDS[1:12]) + " end")]
    items = spark.createDataFrame([(i, " ".join(WORDS[i : i + 15])) for i in range(0, 30, 3)] + [(90, None), (91, "short")], ITEM)
    docs = spark.createDataFrame(rows, DOC).withColumns({"digest": F.lit("d"), "at": F.lit(1), "gram": F.lit("g")})
    got = [sorted(map(tuple, leakage.without_leaks(docs, items, max_broadcast_words=most).collect()), key=repr) for most in (1, 10**6)]
    assert got[0] == got[1] and len(got[0]) == len(rows) and (1, "Before it. ! After it. ", 2) in got[0] and (None, "Before it. ! After it. ", 2) in got[0]
    assert leakage.without_leaks(docs, items.where("false"), max_broadcast_words=-1).where("n_cut > 0").count() == 0


def test_the_filter_lets_every_true_window_through(spark, monkeypatch):
    monkeypatch.setattr(leakage, "FILTER_BYTES", 1 << 15)  # crowded
    items = [(i, " ".join(f"w{(i * 7 + k * k) % 997}" for k in range(60))) for i in range(200)]
    docs = [(i, "x " + " ".join(items[i][1].split()[i % 40 : i % 40 + 12 + i % 2]) + " y") for i in range(200)] + [(1000 + i, " ".join(f"w{(i * 11 + k * 13) % 997}" for k in range(80))) for i in range(50)]
    assert found(spark, docs, items) == found(spark, docs, items, max_broadcast_words=1) and len(found(spark, docs, items)) >= 200


def test_items_that_can_t_be_searched(spark):
    items = [(1, " ".join(WORDS[:12])), (2, " ".join(WORDS[:11])), (2, "a"), (3, None), (None, "x"), (4, "")]
    assert {tuple(r) for r in leakage.too_short(spark.createDataFrame(items, ITEM)).collect()} == {(2, 11), (3, 0), (4, 0)}


def test_spans_point_into_the_text():
    text = "Café días con-\ntinuous don’t x"
    assert [text[a:b] for a, b in leakage.word_spans(text)] == ["Café", "días", "con-\ntinuous", "don’t", "x"]
    assert leakage.words(text) == ["cafe", "dias", "continuous", "dont", "x"]
