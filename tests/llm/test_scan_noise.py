from pyspark.sql import functions as F

from paperloom.llm import scan_noise as N

LINE = "line_id long, file_name string, page_number int, column_index int, x0 double, y0 double, x1 double, y1 double, text string, loaded_at string"
BASE = ["the council of neighbors met in February", "members documented the little-known report", "a little-known panel of neighbors displayed it", "In the county the Journal displayed members"]


def page(no, texts, first_id, file="a.pdf", top="Old Bridge Journal, May 1970"):
    rows = [(first_id, file, no, 0, 40.0, 26.0, 200.0, 36.0, top.replace("#", str(no)), "2020-01-01")]
    for i, t in enumerate(texts, 1):
        rows.append((first_id + i, file, no, 0, 40.0, 48.0 + 12 * i, 280.0, 58.0 + 12 * i, t, "2020-01-01"))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, LINE).withColumn("loaded_at", F.to_timestamp("loaded_at"))


def corpus():
    rows = []
    for p in range(1, 25):
        rows += page(p, BASE * 2, p * 1000)
    return rows


def kinds(spark, rows):
    out = {}
    for r in N.noise(frame(spark, rows)).collect():
        out.setdefault(r.line_id, set()).add(r.noise_kind)
    return out


def test_kinds_of_noise(spark):
    odd = page(30, ["the council of neigbbors met in Fcbruary", "mem,bers and the l@st", "members docu-", "mented the report", "a little-", "known panel of neighbors dis‐", "played it", "~ 30 ~", "1975"], 90000, top="Old Bri~dge Journal, May 1970")
    got = kinds(spark, corpus() + odd)
    assert got[90000] == {"header", "misread"}
    assert got[90001] == {"misread"} and got[90002] == {"misread"}
    assert got[90003] == {"hyphen"} and 90004 not in got and 90005 not in got
    assert got[90006] == {"hyphen"} and 90007 not in got and got[90008] == {"page_number"} and 90009 not in got
    assert all(got[p * 1000] == {"header"} for p in range(1, 25)) and not any(1 <= i % 1000 <= 8 for i in got if i < 90000)


def test_abbreviations_and_wrong_decoding_are_no_misreadings(spark):
    got = kinds(spark, corpus() + page(31, ["the council met at 6 p.m. with neighbors' members", "the council of JosÃ© and the 3rd report"], 91000))
    assert 91001 not in got and 91002 not in got


def test_reloads_blanks_nulls_and_an_empty_table(spark):
    again = [(1001, "a.pdf", 1, 0, 40.0, 60.0, 280.0, 70.0, "the council of neigbbors", "2021-01-01"), (92000, "a.pdf", 2, 0, 1.0, 900.0, 2.0, 910.0, None, None), (92001, "a.pdf", 2, 0, 1.0, 920.0, 2.0, 930.0, "  ", None), (None, "a.pdf", 2, 0, 1.0, 920.0, 2.0, 930.0, "x", None)]
    rows = frame(spark, corpus() + again).withColumns({"cut": F.lit(1), "bones": F.lit("x"), "form": F.lit("y"), "word": F.lit("z")})
    got = {r.line_id: r.noise_kind for r in N.noise(rows).where("line_id in (1001, 92000, 92001) or line_id is null").collect()}
    assert got == {1001: "misread"}
    assert N.noise(frame(spark, corpus()).where("false")).count() == 0


def test_lines_of_junk_paragraphs_are_left_out(spark):
    rows = corpus() + page(33, ["fxvf rkzc ffghx bntcpwm", "mfgpkx c1g hg gwhkgl"], 93000)
    panel = spark.createDataFrame([("a_p33_c0_n2", "a.pdf", "fxvf rkzc ffghx bntcpwm\nmfgpkx c1g hg gwhkgl", None)] + [(f"x{i}", "a.pdf", " ".join(BASE), None) for i in range(20)], "paragraph_id string, file_name string, paragraph_text string, paragraph_text_norm string")
    got = {r.line_id for r in N.noise_outside_junk(frame(spark, rows), panel).collect()}
    assert 93000 in got and not got & {93001, 93002}


def test_paragraphs_are_reflowed(spark):
    odd = page(30, ["the council of neigbbors docu-", "mented the little-", "known report", "~ 30 ~"], 90000)
    row = N.repaired(frame(spark, corpus() + odd)).where("page_number = 30").collect()
    assert [r.text for r in row] == ["the council of neighbors documented the little-known report"]


def only(spark, rows, page_number=30):
    return [r.text for r in N.repaired(frame(spark, corpus() + rows)).where(F.col("page_number") == page_number).orderBy("column_index", "paragraph_in_column").collect()]


def test_lines_stand_in_the_order_of_the_page_not_of_their_ids(spark):
    texts = ["members of the council met in February", "documented the report of neighbors", "displayed in the county Journal"]
    odd = [(90000 - r[0], *r[1:]) for r in page(30, texts, 0)]
    assert only(spark, odd) == [" ".join(texts)]


def test_a_misread_word_that_is_cut_is_mended_once_joined(spark):
    assert only(spark, page(30, ["the council of neigb-", "bors met the mem-", "bcrs, documented"], 90000)) == ["the council of neighbors met the members, documented"]


def test_a_fix_is_for_whole_words():
    assert N._mended("Cat", "Cat", "oat") == "Oat" and N._mended("cat catalog Cat, cat", "cat", "oat") == "oat catalog Cat, oat"
    fix = [{"word": "neigbbors", "right": "neighbors", "at_seam": True}]
    lines = [{"text": "(old-neigb-", "cut": True, "fixes": fix}, {"text": "bors), x", "cut": False, "fixes": None}]
    assert N.reflow(lines) == "(old-neighbors), x"


def test_paragraphs_go_on_over_columns_and_pages(spark):
    below = lambda rows, column: [(r[0] + 100, *r[1:3], column, *r[4:]) for r in rows[1:]]
    one = page(30, ["the council of neighbors met in Febru-"], 90000)
    two = below(page(30, ["ary and members documented the"], 90200), 1)
    three = page(31, ["report of the little-"], 90400)
    four = page(32, ["known panel of neighbors.", "In the county"], 90600)
    rows = one + two + three + four + page(33, ["displayed in the Journal"], 90800) + page(35, ["and it met"], 91000)
    rows = [r for r in rows if "Old Bridge" not in r[8]]
    assert only(spark, rows) == ["the council of neighbors met in February and members documented the report of the little-known panel of neighbors. In the county displayed in the Journal"]
    assert only(spark, rows, 31) == only(spark, rows, 33) == [] and only(spark, rows, 35) == ["and it met"]


def test_a_volume_that_is_numbered_through_has_an_offset_of_its_own(spark):
    rows = [r for p in range(1, 6) for r in page(p, [BASE[0], f"- {p + 200} -"], p * 1000, file="vol.pdf")] + page(6, [BASE[0], "1975"], 6000, file="vol.pdf") + page(7, ["207", BASE[0]], 7000, file="vol.pdf")
    got = {r.line_id for r in N.noise(frame(spark, rows)).where("noise_kind = 'page_number'").collect()}
    assert got == {p * 1000 + 2 for p in range(1, 6)}


def test_page_numbers(spark):
    texts = {"- 12 -": 12, "Page 7": 7, "xiv": 14, "ix": 9, "p. 3": 3, "1975.": None, "12 members": None, "[8]": 8, "": None}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", N.page_number_value(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in rows} == texts


def test_rare_accepted_forms_decide_about_hyphens(spark, monkeypatch):
    rows = corpus()
    for p in range(40, 44):
        rows += page(p, ["members of the committee carried cat and walk", "the part and the time of the part-time panel", "A CATWALK IN THE COUNTY", "the catwalk and the little cottage"], p * 1000)
    odd = ["members of the cat-", "walk displayed the part-", "time report of the cot-", "tage with neigbbors of the c0t-", "tage and the little-", "known CATWALK of zin-", "nober"]
    lines = frame(spark, rows + page(50, odd, 95000)).cache()
    whole = {tuple(r) for r in N.noise(lines).collect()}
    text = [r.text for r in N.repaired(lines).where("page_number = 50").collect()]
    assert (95001, "hyphen", None) in whole and (95002, "hyphen", None) not in whole and "catwalk displayed the part-time report of the cottage" in text[0]
    monkeypatch.setattr(N, "MAX_ACCEPTED", 3)
    assert {tuple(r) for r in N.noise(lines).collect()} == whole
    assert [r.text for r in N.repaired(lines).where("page_number = 50").collect()] == text


def test_verdicts_are_joined_where_they_aren_t_broadcast(spark, monkeypatch):
    lines = frame(spark, corpus() + page(30, ["the council of neigbbors met in Fcbruary", "mem,bers and the l@st"], 90000)).cache()
    whole = {tuple(r) for r in N.noise(lines).collect()}
    monkeypatch.setattr(N, "MAX_VERDICTS", 0)
    assert {tuple(r) for r in N.noise(lines).collect()} == whole
