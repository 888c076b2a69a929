"""Column expressions over text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from paperloom.lexicon import TermLexicon


def normalized(text: Column) -> Column:
    """Lower case, no soft hyphens, straight apostrophes, blanks collapsed and trimmed."""
    plain = F.replace(F.replace(F.lower(text), F.lit("­"), F.lit("")), F.lit("’"), F.lit("'"))
    return F.trim(F.regexp_replace(plain, r"(?U)\s+", " "))


def layout_clean(text: Column) -> Column:
    """Ligatures spelled out, blanks and tabs collapsed, at most one empty line in a row, trimmed."""
    for old, new in (("­", ""), ("ﬁ", "fi"), ("ﬂ", "fl"), ("’", "'")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def hits(text: Column, pattern: str) -> Column:
    """All matches of the pattern's first group, in lower case, distinct, sorted and joined by |."""
    found = F.regexp_extract_all(text, F.lit(f"(?i){pattern}"), F.lit(1))
    return F.array_join(F.array_sort(F.array_distinct(F.transform(found, F.lower))), "|")


def is_in(value: Column, words: list[str]) -> Column:
    return value.isin(list(words))


def normal_token(token: Column, lex: TermLexicon) -> Column:
    """Without outer apostrophes and possessive; policy terms as they are, aliases replaced, plurals cut if that gives a policy term."""
    bare = F.regexp_replace(F.regexp_replace(token, "^'+|'+$", ""), "'s$", "")
    pairs = [F.lit(x) for kv in lex.aliases.items() for x in kv]
    aliased = F.coalesce(F.element_at(F.create_map(*pairs), bare), bare)
    singular = (
        F.when(aliased.endswith("ies"), F.regexp_replace(aliased, "ies$", "y"))
        .when(aliased.endswith("sses"), F.regexp_replace(aliased, "es$", ""))
        .when(aliased.endswith("s") & ~aliased.endswith("ss"), F.regexp_replace(aliased, "s$", ""))
    )
    cut = F.when((F.length(aliased) >= 6) & is_in(singular, lex.policy), singular).otherwise(aliased)
    return F.when(is_in(bare, lex.policy), bare).when(is_in(aliased, lex.policy), aliased).otherwise(cut)


def term_sequence(text: Column, lex: TermLexicon) -> Column:
    """Normal tokens of four letters or more in order, without stop words, identity terms and noise."""
    plain = F.replace(F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("’"), F.lit("'")), F.lit("­"), F.lit(""))
    tokens = F.transform(F.regexp_extract_all(plain, F.lit(r"[a-z][a-z'-]{1,}"), F.lit(0)), lambda t: normal_token(t, lex))
    return F.filter(tokens, lambda t: (F.length(t) >= 4) & ~is_in(t, [*lex.stopwords, *lex.identity, *lex.noise]))


def grams(tokens: Column, n: int) -> Column:
    """The n-grams of an array, as arrays; none if it is shorter."""
    return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.slice(tokens, i, n))).otherwise(F.array().cast("array<array<string>>"))


def corpus_clean(text: Column, stopwords: list[str]) -> Column:
    """Stop words in small letters removed, all but letters as blanks, words of one to three letters dropped, blanks collapsed, lower case."""
    kept = F.regexp_replace(text, rf"\b(?:{'|'.join(stopwords)})\b", "")
    letters = F.regexp_replace(F.regexp_replace(kept, "[^a-zA-Z]+", " "), r"\b[a-zA-Z]{1,3}\b", " ")
    return F.lower(F.trim(F.regexp_replace(letters, " +", " ")))


def metrics(text: Column) -> dict[str, Column]:
    """Counts of characters and tokens, shares of letters, digits and marks, and the share of tokens with letters but no vowel."""
    t = F.coalesce(text, F.lit(""))
    n = F.length(t)
    gone = lambda pattern: n - F.length(F.regexp_replace(t, pattern, ""))
    alpha, digit, space = gone(r"\p{L}"), gone(r"\p{Nd}"), gone(r"(?U)\s")
    tokens = F.filter(F.split(t, r"(?U)\s+"), lambda x: x != "")
    lettered = F.filter(tokens, lambda x: x.rlike("[A-Za-z]"))
    bare = F.filter(lettered, lambda x: ~x.rlike("[aeiouAEIOU]"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    return {
        "n_chars": n,
        "n_tokens": F.size(tokens),
        "n_word_tokens": F.regexp_count(t, F.lit(r"\b[a-zA-Z][a-zA-Z'-]*\b")),
        "alpha_ratio": ratio(alpha, n),
        "digit_ratio": ratio(digit, n),
        "punct_ratio": ratio(F.greatest(F.lit(0), n - alpha - digit - space), n),
        "nonvowel_token_ratio": ratio(F.size(bare), F.size(lettered)),
    }
