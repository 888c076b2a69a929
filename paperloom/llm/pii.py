"""Personal information in free text: found, and replaced by typed placeholders.

Method: bootstrapped contextual extraction. Seed entities that their form alone makes certain induce lexical patterns. A graph joins
patterns with instances, and Spark scores both in turns, a pattern by the instances that it surrounds and an instance by its patterns:

kind              seed                                          pattern                      instance
name              surname after a title; name.surname of mail   words before and after       given name
identity number   labelled as social security number            words after                  label before the number
phone             country code or bracketed area code           word before                  exchange, the figures before the last four
street address    number and a listed kind of street            words before                 kind of street
mail              @, or a listed way to write it                signs for @ and for points   domain

What reaches a high confidence, found in no list, discovers all its mentions: given names make a capitalised pair a person, labels make
a number an identity, contexts and exchanges make seven figures a phone, kinds of street make a number and names an address, and signs
make words a mail address. The kinds of Spanish streets, which stand before the name, are the listed ones.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from paperloom.session import cut_lineage

#: Rounds of scoring, confidence from which a pattern or instance is trusted, mentions that it needs.
ROUNDS, TRUST, MENTIONS = 4, 0.35, 2
#: Mentions that a kind of street outside the list needs, and its confidence.
STREET_MENTIONS, STREET_TRUST = 5, 0.6
#: Trusted words that are broadcast at most, some 20 MB; in a corpus with more, each text gets the ones that it asks for by a join.
MAX_TRUSTED = 200_000
FLUSH = 200_000

# Titles, kinds of street, units, directions, and words that end the names of places and organisations.
TITLES = "Mr Mrs Ms Miss Dr Dra Rev Prof Hon Fr Sr Sra Srta Señor Señora Señorita Don Doña".split()
STREETS = "Street St Avenue Ave Road Rd Drive Dr Lane Ln Boulevard Blvd Court Ct Terrace Ter Place Pl Way Circle Cir Highway Hwy Parkway Pkwy Square Sq Row Alley".split()
CALLES = "Calle Avenida Av Avda Calzada Paseo Carrera Callejón Camino Plaza Bulevar".split()
UNITS = "Apt Apartment Unit Suite Ste Room Rm Floor Fl Depto Piso No Apartado".split()
BODIES = (
    "Foundation Hall Library Institute Society Trust Fund League Coalition Federation Partnership Alliance Center Centre School College University Church Park Bureau Group "
    "Circle Forum Union Press Hospital Clinic Company Association Committee Council County Heights Valley House Club Museum Fundación Biblioteca"
).split()

_U, _L = "A-ZÁÉÍÓÚÑÜ", "a-záéíóúñü"
_W = rf"(?:[{_U}][{_L}]+(?:[{_U}][{_L}]+)?|[{_U}]{{2,}})"
_SUR = rf"{_W}(?:-{_W}| y {_W})?"
_TITLE = rf"(?:{'|'.join(sorted(TITLES + [t.upper() for t in TITLES], key=len, reverse=True))})\.?"
_END = rf"(?!\w|-\w| (?:{'|'.join(STREETS + BODIES)})\b)"
_SIGN = r"[\[({<] ?[A-Za-z]{1,8} ?[\])}>]"
_ANCHOR = re.compile(rf"[{_U}]\w*|\d+|@|{_SIGN}")
_CAPITALS = re.compile(rf"(?<![\w.@+-])(?:(?P<title>{_TITLE}) )?(?P<a>{_W})(?: [{_U}]\.)*(?: (?P<b>{_W}))?(?:(?:-| y ){_W})?(?![\w@])")
_PAIR = re.compile(rf"(?<![\w.@+-]){_W}(?: {_W})?(?: [{_U}]\.)* {_SUR}{_END}")
_TITLED = re.compile(rf"(?<![\w.@+-]){_TITLE} (?P<name>(?:(?:{_W}|[{_U}]\.) )?(?:[{_U}]\. )*{_SUR}){_END}")
_INITIALS = re.compile(rf"(?<![\w.@+#-])(?<!\d )(?<!\d-[{_U}] )(?:[{_U}]\. ){{1,3}}{_SUR}{_END}")
_GIVEN_LAST = re.compile(rf"{_W}(?: [{_U}]\.)*(?![\w-]| (?:[{_U}]\. )?{_W}(?! y\b))")
_SURNAME_BEFORE = re.compile(rf"(?<![\w.@+-])({_SUR}), \Z")

_TLD = r"[A-Za-z]{2,12}"
_EMAIL = re.compile(
    rf"(?<![\w.+-])[\w][\w.+-]*(?:@| @ |@ | @| ?[\[(] ?(?:at|AT|arroba) ?[\])] ?)[A-Za-z0-9][A-Za-z0-9-]*(?:(?:\.| ?[\[(] ?(?:dot|DOT|punto) ?[\])] ?)[A-Za-z0-9-]+)*"
    rf"(?:\.| ?[\[(] ?(?:dot|DOT|punto) ?[\])] ?){_TLD}(?![\w@-])"
)
_MAIL_LIKE = re.compile(rf"(?<![\w.+-])\w[\w.+-]* ?(?P<at>{_SIGN}) ?(?P<domain>[A-Za-z0-9][A-Za-z0-9-]*(?:(?:\.| ?{_SIGN} ?)[A-Za-z0-9-]+)*(?:\.| ?{_SIGN} ?){_TLD})(?![\w@-])")
_INNER_SIGN = re.compile(rf" ?{_SIGN} ?")
_PHONE = re.compile(r"(?<![\w.,/+-])(?<!\d )(?P<code>\+?1[ .-]?)?(?P<area>\(\d{3}\) ?|\d{3}[-./ ])?\d{3}[-. ]\d{2} ?\d{2}(?![\w/-]|[.,]\d)")
_NUMBER = re.compile(r"(?<![\w.-])(?:\d{3} \d{2} \d{4}|[A-Z]{0,3}\d[\dA-Z]*(?:[-./][\dA-Z]+)*)(?![\w-])")
_LABEL = re.compile(r"([^\W\d_]+):?\.? (?:(?:no|n[.º°]+|number|núm)\.? |# ?)?\Z", re.IGNORECASE)
_SSN = re.compile(r"\d{3}[ -]?\d{2}[ -]?\d{4}\Z")
_UNIT = rf"(?:,? (?:{'|'.join(UNITS)})\.? ?#?\d+[A-Z]?(?!\w)|,? ?#\d+[A-Z]?)?"
_STREET = re.compile(
    rf"(?<![\w.,/-])\d{{1,5}}(?:-?[A-Z])?(?: [NSEW]\.| (?:North|South|East|West))?(?: (?:{_W}|[a-z]{{2,3}}(?= {_W}))){{1,4}} (?:{'|'.join(STREETS + [s.upper() for s in STREETS])})\b\.?{_UNIT}"
)
_STREET_LIKE = re.compile(rf"(?<![\w.,/-])\d{{1,5}}(?:-?[A-Z])?(?: [NSEW]\.| (?:North|South|East|West))?(?: (?:{_W}|[a-z]{{2,3}}(?= {_W}))){{1,4}} (?P<kind>{_W})\b\.?{_UNIT}")
_CALLE = re.compile(rf"(?<!\w){_W}\.? (?:(?:{_W}|de|del|la|las|los|el) ){{1,4}}(?:(?:No|Núm|N)\.? ?|# ?)?\d{{1,5}}(?:-?[A-Z])?(?![\w.-]*\d){_UNIT}")
_TITLE_WORDS = {*TITLES, *(t.upper() for t in TITLES)}
_CALLE_WORDS = {*CALLES, *(t.upper() for t in CALLES)}
_ODD_BLANK = re.compile(r"[^\S\n ]")
_BLANKS = re.compile(r"[^\S\n]{2,}|[^\S\n ]")
_LINE_END = re.compile(r" ?\n ?(?!\s)")
_BROKEN = re.compile(r"(?<=\w)-[^\S\n]*\n[^\S\n]*(?=\w)")
_LOCAL = re.compile(r"([a-zñ]{2,})\.([a-zñ]{2,})")


_DIGITS = str.maketrans("0123456789", "#" * 10)


def smooth(text: str) -> str:
    """The text with soft hyphens gone, accents composed, and each single line break, odd blank or run of blanks as one blank; paragraphs stay apart."""
    plain = text.isascii()
    if not plain:
        text = text.replace("\u00ad", "").replace("\u00a0", " ")
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
    broken = "\n" in text
    if broken and "-" in text:
        text = _BROKEN.sub("-", text)
    if "  " in text or (any(ch in text for ch in "\t\r\f\v\x1c\x1d\x1e\x1f") if plain else _ODD_BLANK.search(text)):
        text = _BLANKS.sub(" ", text)
    return _LINE_END.sub(" ", text) if broken else text


def item_key(item: str) -> str:
    return "".join(ch for ch in item.lower() if ch.isalnum())


#: Characters in which the words of a context are looked for first; where they don't fit, twice as many are.
NEAR = 28


def _before(text: str, at: int, n: int = 2) -> str:
    """The n whole words before `at` in its paragraph, with # for figures."""
    size = NEAR
    while True:
        low = max(0, at - size)
        _, end, part = text[low:at].rpartition("\n")
        words = part.split()
        if len(words) > n or end or not low:
            return " ".join(words[-n:]).lower().translate(_DIGITS)
        size *= 2


def _after(text: str, at: int) -> str:
    """The two whole words from `at` in its paragraph, with # for figures."""
    size = NEAR
    while True:
        part, end, _ = text[at : at + size].partition("\n")
        words = part.split(None, 2)
        if len(words) > 2 or end or at + size >= len(text):
            return " ".join(words[:2]).lower().translate(_DIGITS)
        size *= 2


def _labelled(text: str, at: int) -> tuple[str, re.Match] | None:
    """The word before a number that starts at `at`, and the number, if it has five figures or more."""
    m = _NUMBER.match(text, at)
    if not m or sum(ch.isdigit() for ch in m[0]) < 5:
        return None
    low = max(0, at - NEAR)
    while low and text[low - 1].isalpha():
        low -= 1
    label = _LABEL.search(text, low, at)
    return (label[1].lower(), m) if label else None


def _phone(text: str, at: int) -> re.Match | None:
    return _PHONE.match(text, at - 1 if at and text[at - 1] in "(+" else at)


def _certain(phone: re.Match) -> bool:
    """A country code or a bracketed area code."""
    return bool(phone["code"]) or bool(phone["area"] and phone["area"][0] == "(")


def _exchange(phone: re.Match) -> str:
    """The three figures before the last four."""
    return "".join(ch for ch in phone[0] if ch.isdigit())[-7:-4]


def _mail_start(text: str, at: int) -> int:
    """Where the word ends on the left that a sign for @ stands behind, with a blank between them at most."""
    low = at - 1 if at and text[at - 1] == " " else at
    while low and (text[low - 1].isalnum() or text[low - 1] in "_.+-"):
        low -= 1
    return low


def _email(text: str, at: int) -> tuple[int, int] | None:
    """The address around a listed sign for @."""
    m = _EMAIL.match(text, _mail_start(text, at))
    return m.span() if m and m.start() < at < m.end() else None


def _mail_like(text: str, at: int) -> tuple[str, str, tuple[int, int]] | None:
    """The signs, the domain and the place of what may be an address around a bracketed word."""
    m = _MAIL_LIKE.match(text, _mail_start(text, at))
    if not m or m.start("at") != at:
        return None
    signs = [x.strip() for x in (m["at"], *_INNER_SIGN.findall(m["domain"]))]
    return " ".join(signs).replace("( ", "(").lower(), _INNER_SIGN.sub(".", m["domain"]).lower(), m.span()


def _street(text: str, at: int) -> tuple[re.Match, str, bool] | None:
    """What may be an address at a number: the match, its kind of street, and whether that is a listed one."""
    m = _STREET.match(text, at)
    if m:
        return m, "", True
    m = _STREET_LIKE.match(text, at)
    return (m, m["kind"].lower(), False) if m else None


def evidence(text: str) -> Iterator[tuple[str, str, str, bool]]:
    """(kind, pattern, instance, seed): what a text tells of contexts and of what they surround."""
    done = 0
    for anchor in _ANCHOR.finditer(text):
        at = anchor.start()
        if at < done:
            continue
        ch = text[at]
        if ch.isdigit() or (ch.isalpha() and anchor[0][-1].isdigit()):
            phone = _phone(text, at) if ch.isdigit() else None
            number = _labelled(text, at)
            if number:
                seed = number[0] in ("ssn", "security") and bool(_SSN.match(number[1][0]))
                yield "identity_number", f"_ {_after(text, number[1].end())}", number[0], seed
                done = number[1].end()
            if phone:
                yield "phone", _before(text, phone.start(), 1), _exchange(phone), _certain(phone)
                done = max(done, phone.end())
            elif not number and ch.isdigit():
                street = _street(text, at)
                if street:
                    yield "street_address", f"{_before(text, at)} _", street[1], street[2]
        elif ch.isalpha():
            m = _CAPITALS.match(text, at)
            if not m:
                continue
            done = m.end()
            if not m["title"] and not m["b"]:
                continue
            first = "" if m["title"] else m["a"].lower()
            left, right = _before(text, at), _after(text, done)
            if left and left[-1] not in ".!?":
                yield "name", f"{left} _", first, bool(m["title"])
            if right and right[0] not in ".!?":
                yield "name", f"_ {right}", first, bool(m["title"])
        else:
            span = _email(text, at)
            local = _LOCAL.match(text[span[0] : at].lower()) if span else None
            if local:
                yield "name", "_@", local[1], True
            if span and ch == "@":
                yield "email", "@", _INNER_SIGN.sub(".", text[at + 1 : span[1]].strip().lower()), True
            if span:
                done = span[1]
            elif ch != "@":
                like = _mail_like(text, at)
                if like:
                    yield "email", like[0], like[1], False
                    done = like[2][1]


def gather(documents: DataFrame) -> DataFrame:
    """(kind, pattern, instance, n, n_seed) over all documents, added up within each task before they are shuffled."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()

        def out() -> pd.DataFrame:
            rows = pd.DataFrame([(*k[:3], n, n if k[3] else 0) for k, n in seen.items()], columns=["kind", "pattern", "instance", "n", "n_seed"])
            seen.clear()
            return rows

        for batch in batches:
            for text in batch["text"]:
                seen.update(evidence(smooth(text)))
            if len(seen) > FLUSH:
                yield out()
        yield out()

    rows = documents.where("text is not null").select("text").mapInPandas(count, "kind string, pattern string, instance string, n long, n_seed long")
    return rows.groupBy("kind", "pattern", "instance").agg(F.sum("n").alias("n"), F.sum("n_seed").alias("n_seed"))


def score(edges: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(kind, pattern, conf, n) and (kind, instance, conf, n), scored in turns.

    A pattern's confidence is the mean confidence of what it surrounds, seeds counting 1, drawn towards 0 where it is rare; an
    instance's is the mean of its patterns', seeds counting 1.
    """
    edges = cut_lineage(edges)
    seeds = edges.groupBy("kind", "pattern").agg(F.sum("n").alias("n"), F.sum("n_seed").alias("n_seed"))
    patterns = seeds.select("kind", "pattern", (F.col("n_seed") / (F.col("n_seed") + 1.0)).alias("conf"), "n")
    real = edges.where("instance <> ''")
    for i in range(rounds):
        joined = real.join(patterns.drop("n"), ["kind", "pattern"])
        instances = joined.groupBy("kind", "instance").agg(F.sum("n").alias("n"), (F.sum(F.col("n_seed") + (F.col("n") - F.col("n_seed")) * F.col("conf")) / F.sum("n")).alias("conf"))
        if i == rounds - 1:
            break
        back = edges.join(instances.select("kind", "instance", "conf"), ["kind", "instance"], "left")
        worth = F.when(F.col("n_seed") == F.col("n"), F.col("n")).otherwise(F.col("n_seed") + (F.col("n") - F.col("n_seed")) * F.coalesce("conf", F.lit(0.0)))
        patterns = cut_lineage(back.groupBy("kind", "pattern").agg((F.sum(worth) / (F.sum("n") + 1.0)).alias("conf"), F.sum("n").alias("n")))
    return patterns, instances


@dataclass
class Trusted:
    """Words of high confidence; `calls` are words before phones, `off` words before numbers that look like phones and are none."""

    names: set[str] = field(default_factory=set)
    labels: set[str] = field(default_factory=set)
    calls: set[str] = field(default_factory=set)
    off: set[str] = field(default_factory=set)
    exchanges: set[str] = field(default_factory=set)
    streets: set[str] = field(default_factory=set)
    signs: set[str] = field(default_factory=set)

    @classmethod
    def of(cls, rows: list) -> Trusted:
        """From (role, word); roles are the names of the fields."""
        found = cls()
        for row in rows:
            getattr(found, row["role"]).add(row["word"])
        return found


def learn(documents: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(role, word) of what is trusted, by the fields of Trusted, from all documents."""
    patterns, instances = score(gather(documents), rounds)
    sure = (F.col("conf") >= TRUST) & (F.col("n") >= MENTIONS)
    role = F.when(F.col("kind") == "street_address", F.when((F.col("conf") >= STREET_TRUST) & (F.col("n") >= STREET_MENTIONS), "streets"))
    role = role.when(sure & (F.col("kind") == "name"), "names").when(sure & (F.col("kind") == "identity_number"), "labels").when(sure & (F.col("kind") == "phone"), "exchanges")
    by_pattern = F.when(F.col("kind") == "phone", F.when(sure, "calls").when(F.col("n") >= MENTIONS, "off")).when(sure & (F.col("kind") == "email"), "signs")
    rows = instances.select(role.alias("role"), F.col("instance").alias("word")).unionByName(patterns.select(by_pattern.alias("role"), F.col("pattern").alias("word")))
    return cut_lineage(rows.where("role is not null and word <> '@'"))


def find(text: str, trusted: Trusted) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the items of a smoothed text, in order, none overlapping.

    The text is read once from left to right. A number is an identity if its label is trusted, else the start of an address, else a
    phone if its form is certain or its context trusted; where the context is unknown, its exchange or a written area code decides.
    Capitalised words are read as a title, a street's Spanish name, a trusted given name or initials.
    """
    found: list[tuple[int, int, str]] = []
    done = 0
    names = trusted.names

    def take(start: int, end: int, kind: str) -> None:
        nonlocal done
        while found and found[-1][1] > start:  # an address of mail reaches back over what its name part looked like
            found.pop()
        found.append((start, end, kind))
        done = end

    for anchor in _ANCHOR.finditer(text):
        at = anchor.start()
        ch = text[at]
        if not ch.isalnum():
            span = _email(text, at)
            if span:
                take(*span, "email")
            elif trusted.signs and ch != "@" and (like := _mail_like(text, at)) and like[0] in trusted.signs:
                take(*like[2], "email")
            continue
        if at < done:
            continue
        word = anchor[0]
        if ch.isdigit() or word[-1].isdigit():
            number = _labelled(text, at)
            if number and number[0] in trusted.labels:
                take(*number[1].span(), "identity_number")
            elif ch.isdigit() and (m := _street(text, at)) and (m[2] or m[1] in trusted.streets):
                take(*m[0].span(), "street_address")
            elif ch.isdigit() and (m := _phone(text, at)):
                before = _before(text, m.start(), 1)
                if _certain(m) or before in trusted.calls or (before not in trusted.off and (m["area"] or _exchange(m) in trusted.exchanges)):
                    take(*m.span(), "phone")
            continue
        if word in _CALLE_WORDS and (m := _CALLE.match(text, at)):
            take(*m.span(), "street_address")
        elif word in _TITLE_WORDS and (m := _TITLED.match(text, at)):
            take(*m.span("name"), "name")
        elif word.lower() in names:
            turned = text[at - 2 : at] == ", " and _GIVEN_LAST.match(text, at)
            low = max(done, text.rfind("\n", 0, at) + 1) if turned else at
            before = turned and _SURNAME_BEFORE.search(text[low:at])
            if before and before[1].lower() not in names:
                take(low + before.start(1), turned.end(), "name")
            elif m := _PAIR.match(text, at):
                take(*m.span(), "name")
        elif len(word) == 1 and text[at + 1 : at + 2] == "." and (m := _INITIALS.match(text, at)):
            take(*m.span(), "name")
    return found


def asked(text: str) -> set[tuple[str, str]]:
    """Every (role, word) that find() may ask for in a smoothed text."""
    out = set()
    for anchor in _ANCHOR.finditer(text):
        at, word = anchor.start(), anchor[0]
        if not word[0].isalnum():
            like = _mail_like(text, at) if word != "@" else None
            out |= {("signs", like[0])} if like else set()
        elif word[0].isdigit() or word[-1].isdigit():
            number, street, phone = _labelled(text, at), _street(text, at), _phone(text, at)
            out |= {("labels", number[0])} if number else set()
            out |= {("streets", street[1])} if street else set()
            out |= {("calls", before := _before(text, phone.start(), 1)), ("off", before), ("exchanges", _exchange(phone))} if phone else set()
        else:
            out.add(("names", word.lower()))
    return out


def _with_found(documents: DataFrame, emit: Callable, schema: str, trusted: Trusted | None, max_trusted: int) -> DataFrame:
    """What emit(ids, texts, smoothed texts, found items) makes of each batch of (doc_id, text).

    Up to `max_trusted` trusted words are broadcast; beyond that every different text gets those that it asks for by a join.
    """
    known = learn(documents) if trusted is None else None
    if trusted is None and known.count() <= max_trusted:
        trusted = Trusted.of(known.collect())  # at most max_trusted rows
    rows = documents.select("doc_id", "text")
    if trusted is not None:
        shared = documents.sparkSession.sparkContext.broadcast(trusted.__dict__)  # plain sets, as workers may lack this package

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own = Trusted(**shared.value)
            for batch in batches:
                texts = batch["text"].tolist()
                flat = [smooth(t) if t else "" for t in texts]
                yield emit(batch["doc_id"], texts, flat, [find(t, own) for t in flat])

        return rows.mapInPandas(scan, schema)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(d, *x) for d, t in zip(batch["digest"], batch["text"], strict=True) for x in sorted(asked(smooth(t)))], columns=["digest", "role", "word"])

    def scan_each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            flat = [smooth(t) if t else "" for t in texts]
            owns = [Trusted.of(x) if x is not None else Trusted() for x in batch["own"]]
            yield emit(batch["doc_id"], texts, flat, [find(t, own) for t, own in zip(flat, owns, strict=True)])

    rows = rows.withColumn("digest", F.sha2("text", 256))
    each = rows.where("digest is not null").groupBy("digest").agg(F.first("text").alias("text"))
    own = each.mapInPandas(ask, "digest string, role string, word string").join(known, ["role", "word"]).groupBy("digest").agg(F.collect_list(F.struct("role", "word")).alias("own"))
    return rows.join(own, "digest", "left").select("doc_id", "text", "own").mapInPandas(scan_each, schema)


def items(documents: DataFrame, trusted: Trusted | None = None, max_trusted: int = MAX_TRUSTED) -> DataFrame:
    """(doc_id, pii_kind, item_key), distinct: the items of each document. Null and empty texts have none; rows without doc_id are left out."""

    def emit(ids: pd.Series, texts: list, flat: list[str], found: list) -> pd.DataFrame:
        rows = {(doc, kind, item_key(t[s:e])) for doc, t, spans in zip(ids.tolist(), flat, found, strict=True) for s, e, kind in spans}
        return pd.DataFrame(sorted(rows), columns=["doc_id", "pii_kind", "item_key"])

    schema = f"doc_id {dict(documents.dtypes)['doc_id']}, pii_kind string, item_key string"
    return _with_found(documents.where("doc_id is not null and text is not null"), emit, schema, trusted, max_trusted).distinct()


def redacted(documents: DataFrame, trusted: Trusted | None = None, max_trusted: int = MAX_TRUSTED) -> DataFrame:
    """(doc_id, clean_text, n_items): each text with [EMAIL], [PHONE], [IDENTITY_NUMBER], [STREET_ADDRESS] and [NAME] for its items. A null text stays null; a text without items stays as it is."""

    def emit(ids: pd.Series, texts: list, flat: list[str], found: list) -> pd.DataFrame:
        clean = []
        for text, t, spans in zip(texts, flat, found, strict=True):
            for s, e, kind in reversed(spans):
                t = f"{t[:s]}[{kind.upper()}]{t[e:]}"
            clean.append(t if spans else text)
        return pd.DataFrame({"doc_id": ids, "clean_text": clean, "n_items": [len(spans) for spans in found]})

    return _with_found(documents, emit, f"doc_id {dict(documents.dtypes)['doc_id']}, clean_text string, n_items int", trusted, max_trusted)
