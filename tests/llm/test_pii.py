import random
import re

import pytest
from pyspark.sql import functions as F

from paperloom.llm import pii

DOC = "doc_id long, text string"
TRUSTED = pii.Trusted(names={"amalia", "oscar", "ruth"}, labels={"ssn", "number", "passport", "cédula", "security"}, calls={"at", "call"}, off={"pages"})


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Write to desk+page2@puente.example today", [("email", "deskpage2puenteexample")]),
        ("Questions? hector.x [at] gazette [dot] example", [("email", "hectorxatgazettedotexample")]),
        ("Seats @ 931 cents", []),
        ("can be reached at +1 701 555 0112 most evenings", [("phone", "17015550112")]),
        ("Call (407)555-01 65 now", [("phone", "4075550165")]),
        ("Call 555-0139", [("phone", "5550139")]),
        ("See volume 96, pages 915-6007.", []),
        ("SSN 952 45 7923, then", [("identity_number", "952457923")]),
        ("social security number 960-44-2284; x", [("identity_number", "960442284")]),
        ("cédula 60.853.873-K and", [("identity_number", "60853873k")]),
        ("passport XX882918.", [("identity_number", "xx882918")]),
        ("Grant file 77.180.4076 was closed. Order form 656-49-5857", []),
        ("Go to 726-B Halfmoon Drive, Apt. 7, Valdera", [("street_address", "726bhalfmoondriveapt7")]),
        ("a Calle Nogal No. 6985 y", [("street_address", "callenogalno6985")]),
        ("from Tannery Road to Old Ferry Lane", []),
        ("by Oscar H. Wexadoza y Marleta.", [("name", "oscarhwexadozaymarleta")]),
        ("ask for Halvowick, Amalia (x)", [("name", "halvowickamalia")]),
        ("in Altavela, Ruth Dormelan came", [("name", "ruthdormelan")]),
        ("E. S. Halvowick and RUTH WEXELAN", [("name", "eshalvowick"), ("name", "ruthwexelan")]),
        ("Mrs. Torvezorro and Dr. Ruth Quinelan", [("name", "torvezorro"), ("name", "ruthquinelan")]),
        ("The Dormowick Foundation and Torvelan Hall; 12 N. Marigold Street", [("street_address", "12nmarigoldstreet")]),
    ],
)
def test_forms(text, expected):
    flat = pii.smooth(text)
    assert [(k, pii.item_key(flat[s:e])) for s, e, k in pii.find(flat, TRUSTED)] == expected


def corpus(n=400):
    rnd = random.Random(4)
    given, end = ["Amalia", "Oscar", "Ruth", "Hugo", "Celia", "Walter"], ["owick", "anessa", "istane", "uindo"]
    surname = lambda: rnd.choice(["Torv", "Wex", "Dorm", "Halv"]) + rnd.choice(end)
    docs, truth = [], set()
    for i in range(n):
        g, s, kind = rnd.choice(given), surname(), i % 6
        place = rnd.choice(["Solana Heights", "Arroyo Gris", "Ribera Alta"])
        if kind == 0:
            text, items = f"Minutes taken by Dr. {s}. Nobody from {place} came.", [("name", s)]
        elif kind == 1:
            text, items = f"Minutes taken by {g} {s}. Nobody from {place} came.", [("name", g + s)]
        elif kind == 2:
            text, items = f"The chair, {g} {s}, spoke in {place}. The {s} Foundation paid.", [("name", g + s)]
        elif kind == 3:
            text, items = f"The chair, Mrs. {s}, spoke in {place}.", [("name", s)]
        elif kind == 4:
            label, number = rnd.choice([("SSN", f"{900 + i % 99}-{10 + i % 89}-{1000 + i}"), ("passport", f"XQ{100000 + i}")])
            text, items = f"A donor gave the {label} {number} and asked for it. Grant file {10 + i % 89}.{100 + i}.{1000 + i} was closed.", [("identity_number", number)]
        else:
            number = f"555-{1000 + i}"
            text, items = f"Call {rnd.choice(['', '+1 701 '])}{number} before noon. See pages {100 + i}-{2000 + i}.", [("phone", None)]
            items = [("phone", text.split("Call ")[1].split(" before")[0])]
        docs.append((i, text))
        truth |= {(i, k, pii.item_key(v)) for k, v in items}
    return docs, truth


def test_seeds_lead_to_unseen_names_labels_and_contexts(spark):
    docs, truth = corpus()
    df = spark.createDataFrame(docs, DOC)
    known = pii.Trusted.of(pii.learn(df).collect())
    assert known.names == {"amalia", "oscar", "ruth", "hugo", "celia", "walter"} and known.labels == {"ssn", "passport"} and known.off == {"pages"}
    assert {tuple(r) for r in pii.items(df).collect()} == truth
    assert {tuple(r) for r in pii.items(df, max_trusted=0).collect()} == truth
    both = [sorted(map(tuple, pii.redacted(df.unionByName(df.limit(3)), max_trusted=most).collect())) for most in (0, 10**6)]
    assert both[0] == both[1] and len(both[0]) == len(docs) + 3


def test_patterns_discover_phones_streets_and_ways_to_write_mail(spark):
    docs = []
    for i in range(40):
        docs.append(f"Ring +1 701 555 {1000 + i} by noon. Send it to {10 + i} Marigold Street, please. Ask desk{i}@puente.example about it.")
        docs.append(f"Ring 555-{3000 + i} by noon. Send it to {60 + i} Halfmoon Crescent, please. Ask gate{i} <bei> puente <punkt> example about it.")
        docs.append(f"Dial 555-{5000 + i} by noon. In all, {60 + i} Solana Heights came. See pages {100 + i}-{2000 + i}. One (see) puente.net and so on.")
    df = spark.createDataFrame(list(enumerate(docs)), DOC)
    known = pii.Trusted.of(pii.learn(df).collect())
    assert {"ring", "dial"} <= known.calls and known.off == {"pages"} and known.exchanges == {"555"} and known.streets == {"crescent"} and known.signs == {"<bei> <punkt>"}
    got = {tuple(r) for r in pii.items(df).where("pii_kind <> 'name'").collect()}
    keys = lambda i: {("phone", f"1701555{1000 + i}"), ("street_address", f"{10 + i}marigoldstreet"), ("email", f"desk{i}puenteexample"), ("phone", f"555{3000 + i}"), ("street_address", f"{60 + i}halfmooncrescent"), ("email", f"gate{i}beipuentepunktexample"), ("phone", f"555{5000 + i}")}
    assert {x[1:] for x in got} == {k for i in range(40) for k in keys(i)}
    without = pii.Trusted(**(known.__dict__ | {"calls": set(), "exchanges": set(), "streets": set(), "signs": set()}))
    assert len({tuple(r) for r in pii.items(df, without).where("pii_kind <> 'name'").collect()}) == 3 * 40


def test_smoothing_in_parts_is_the_same_as_at_once():
    rnd = random.Random(9)
    whole = re.compile(r"[^\S\n]*\n[^\S\n]*(?!\s)|[^\S\n]{2,}|[^\S\n ]")
    for _ in range(3000):
        text = "".join(rnd.choice(["a", "b-", " ", " ", "\n", "\t", "\r", "\u2009", "é"][: rnd.choice([5, 9])]) for _ in range(rnd.randint(0, 14)))
        assert pii.smooth(text) == whole.sub(" ", pii._BROKEN.sub("-", text)), repr(text)


def test_asked_covers_what_find_looks_up():
    docs, _ = corpus(60)

    class Spy(set):
        def __contains__(self, x):
            used.add(x)
            return set.__contains__(self, x)

    for _, text in docs:
        used = set()
        known = pii.Trusted(*(Spy({"amalia", "passport", "call", "555"}) for _ in range(7)))
        pii.find(pii.smooth(text), known)
        assert used <= {w for _, w in pii.asked(pii.smooth(text))}


def test_placeholders_nulls_repeats_and_clashes(spark):
    rows = [(1, "Write to Mrs. Torvezorro at desk@puente.example."), (2, None), (3, ""), (4, "Nothing here.\nAt all."), (5, "x " * 100000), (1, "again"), (None, "Mr. Wexelan came")]
    df = spark.createDataFrame(rows, DOC).withColumns({"pii_kind": F.lit("k"), "item_key": F.lit("i"), "n_items": F.lit(3)})
    got = [(r.doc_id, r.clean_text, r.n_items) for r in pii.redacted(df).collect()]
    assert (1, "Write to Mrs. [NAME] at [EMAIL].", 2) in got and (2, None, 0) in got and (3, "", 0) in got and (4, "Nothing here.\nAt all.", 0) in got
    found = {tuple(r) for r in pii.items(df).collect()}
    assert found == {(1, "name", "torvezorro"), (1, "email", "deskpuenteexample")}
    assert pii.items(df.where("false")).count() == 0 and pii.redacted(df.where("false")).count() == 0


@pytest.mark.parametrize("end", ["\r\n", "  \n", "\t\n", "\n", " \n  "])
def test_items_broken_at_a_hyphen_with_any_line_end(end):
    flat = pii.smooth(f"passport A078-935-{end}975, call 407-555-{end}0165, by Ruth Wexelan-{end}Torvelan.")
    assert flat == "passport A078-935-975, call 407-555-0165, by Ruth Wexelan-Torvelan."


@pytest.mark.parametrize("blank", ["\u2009", "\u202f", "\f", "\t", "\r", "\u00a0"])
def test_odd_blanks_are_plain_ones(blank):
    flat = pii.smooth(f"by{blank}Ruth{blank}Quinelan, 12{blank}N. Marigold{blank}Street")
    assert [(k, pii.item_key(flat[s:e])) for s, e, k in pii.find(flat, TRUSTED)] == [("name", "ruthquinelan"), ("street_address", "12nmarigoldstreet")]


def test_contexts_are_whole_words():
    rnd = random.Random(7)
    for _ in range(500):
        text = "".join(rnd.choice(["a" * rnd.randint(1, 45), " ", " ", "7", "\n"]) for _ in range(12))
        at = rnd.randint(0, len(text))
        figures = lambda words: " ".join(words).replace("7", "#")
        for n in (1, 2):
            assert pii._before(text, at, n) == figures(text[:at].split("\n")[-1].split()[-n:])
        assert pii._after(text, at) == figures(text[at:].split("\n")[0].split()[:2])
