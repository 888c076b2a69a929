import random
from collections import defaultdict

from pyspark.sql import functions as F

from paperloom.llm import lines

SCHEMA = "paragraph_id string, file_name string, paragraph_text string"
NOTICE = "Opinions in this column are those of the signer alone."


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(rows):
    form = lambda s: "".join(ch for ch in s.lower() if ch.isalpha())
    once = {}
    for p, f, t in rows:
        if p is not None:
            once[p] = max(once.get(p, (None, None)), (f, t), key=lambda x: (x[0] is not None, x[0] or "", x[1] is not None, x[1] or ""))
    n, seen = defaultdict(set), defaultdict(set)
    for p, (f, t) in once.items():
        n[f].add(p)
        for line in (t or "").split("\n"):
            seen[f, form(line)].add(p)
    much = defaultdict(list)
    for (f, x), ps in seen.items():
        if len(x) >= 20 and len(ps) >= 5 and len(ps) >= 0.01 * len(n[f]):
            much[f].append(x)
    return {(p, i) for p, (f, t) in once.items() for i, line in enumerate((t or "").split("\n"), 1) if any(edits(form(line), x) <= 2 for x in much[f])}


def test_against_brute_force(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(120):
        body = [" ".join(rnd.choice(["river", "council", "meeting", "school", "lantern"]) + str(rnd.randint(0, 9)) for _ in range(6)) for _ in range(2)]
        if i % 3 == 0:
            notice = list(NOTICE)
            for _ in range(rnd.randint(0, 4)):
                k = rnd.randrange(len(notice))
                notice[k] = rnd.choice(["x", "", "yz", notice[k]])
            body.insert(rnd.randint(0, 2), "".join(notice).upper() if i % 2 else "  " + "".join(notice))
        rows.append((f"p{i}", "a" if i % 4 else None, "\n".join(body)))
    rows += [(f"q{i}", "b", NOTICE) for i in range(6)] + [("p0", rows[0][1], rows[0][2]), (None, "b", NOTICE), ("e", "b", ""), ("n", "b", None)]
    got = {tuple(r) for r in lines.repeated_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows) and len(got) > 20
    beyond = {tuple(r) for r in lines.repeated_lines(spark.createDataFrame(rows, SCHEMA), max_broadcast=0).collect()}
    assert beyond == got
    texts = [{tuple(r) for r in lines.without_repeated_lines(spark.createDataFrame(rows, SCHEMA), max_broadcast=most).collect()} for most in (0, 100)]
    assert texts[0] == texts[1] and sum(r[2] for r in texts[0]) == len(got)


def test_trees_merge_to_what_one_tree_holds():
    rnd = random.Random(3)
    rows = [(rnd.choice("ab"), lines.path_of([rnd.choice(["ab", "cde", "f" * 9]) for _ in range(4)])) for _ in range(300)]
    whole, parts = lines.TokenTree(), [lines.TokenTree(), lines.TokenTree()]
    for i, row in enumerate(rows):
        whole.add(*row)
        parts[i % 2].add(*row)
    parts[0].merge(parts[1])
    assert sorted(parts[0].leaves()) == sorted(whole.leaves()) and parts[0].n_leaves == whole.n_leaves and sum(n for *_, n in whole.leaves()) == 300


def test_slots_keep_tokens_and_figures_are_wild():
    assert lines.template("No. 12, JUNE 3rd: the l4st dáy!") == ["no", "june", "rd", "the", "lst", "dáy"]
    assert lines.path_of(lines.template("Opinions in this column are those of the signer")) == ("opinionsinthis", "columnarethose", "ofthesigner")
    assert lines.path_of(["abcdefghijklmnopqrstuvwxyz"]) == ("abcdefghi", "jklmnopq", "rstuvwxyz")
    assert lines.templates_of(None) == [[]] and lines.templates_of("") == [[]] and lines.templates_of("x\n\ny") == [["x"], [], ["y"]]


def test_the_wildcard_tree_finds_every_near_line():
    rnd = random.Random(5)
    paths = [lines.path_of([rnd.choice(["ab", "abab", "cde", "aaa"]) for _ in range(rnd.randint(7, 9))]) for _ in range(60)]
    tree, whole = lines.WildcardTree(paths), ["".join(p) for p in paths]
    for _ in range(800):
        x = list(rnd.choice(whole))
        for _ in range(rnd.randint(0, 4)):
            x[rnd.randrange(len(x))] = rnd.choice(["", "a", "b", "xy", "c"])
        x = "".join(x)
        assert tree.covers(x) == any(edits(x, t) <= 2 for t in whole)


def test_words_cut_by_blanks_are_the_same_form(spark):
    spaced = NOTICE.replace("column", "co lumn").replace("signer", "si gner")
    rows = [(f"p{i}", "a", f"x{i}\n{NOTICE if i % 2 else spaced}") for i in range(5)] + [("q", "a", NOTICE.replace("those", "th0se").replace("of", "0f") + " 7")]
    assert {tuple(r) for r in lines.repeated_lines(spark.createDataFrame(rows, SCHEMA)).collect()} == {*((f"p{i}", 2) for i in range(5)), ("q", 1)}


def test_thresholds_are_inclusive_and_per_source(spark):
    rows = [(f"p{i}", "a", f"unique line number {chr(97 + i)} of text\n{NOTICE}") for i in range(5)] + [(f"q{i}", "b", NOTICE) for i in range(4)]
    got = {tuple(r) for r in lines.repeated_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(f"p{i}", 2) for i in range(5)}


def test_removal_keeps_the_rest_and_nulls(spark):
    rows = [(f"p{i}", "a", f"line {i}\n{NOTICE}\nend") for i in range(5)] + [("only", "a", NOTICE), ("null", "a", None), ("empty", "a", "")]
    panel = spark.createDataFrame(rows, SCHEMA).withColumns({"path": F.lit("x"), "source": F.lit("s"), "n": F.lit(1), "letters": F.lit(2), "piece": F.lit(3)})
    got = {r.paragraph_id: (r.clean_text, r.n_removed) for r in lines.without_repeated_lines(panel).collect()}
    assert got["p3"] == ("line 3\nend", 1) and got["only"] == ("", 1) and got["null"] == (None, 0) and got["empty"] == ("", 0)


def test_empty_table_and_long_text(spark):
    assert lines.repeated_lines(spark.createDataFrame([], SCHEMA)).count() == 0
    long = "\n".join([NOTICE] * 3 + [f"w{i}" for i in range(20000)])
    assert lines.repeated_lines(spark.createDataFrame([(f"p{i}", "a", long) for i in range(5)], SCHEMA)).count() == 15
