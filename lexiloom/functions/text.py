"""Text functions: folding, tokens, brackets and word classes, as column expressions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: marker sets
BREAKS = r"""[\x00-\x20!"#$%&()*+,./:;<=>?@\[\\\]^_`{|}~]+"""
PUNCTUATION = "、。।，？！!@“（）”：:；;.,?&«»…"
QUOTES = "\"“”«»「」『』„‟"
CLITICS = "'’‘"
COMPOUNDS = "-"
BRACKETS = (("[", "]"), ("{", "}"), ("<", ">"), ("(", ")"), ("＜", "＞"))


def character_class(marks: str, negated: bool = False) -> str:
    """A regular expression class of these characters; a hyphen stands first, where it is no range."""
    rest = "".join(re.escape(x) for x in dict.fromkeys(marks) if x != "-")
    return "[" + ("^" if negated else "") + ("-" if "-" in marks else "") + rest + "]"


def marker_patterns(punctuation: str = PUNCTUATION, clitics: str = CLITICS, compounds: str = COMPOUNDS, quotes: str = QUOTES) -> dict[str, str]:
    """Patterns made from marker lists: edges to strip, breaks inside a word, clitic and compound marks."""
    edge = character_class(punctuation + quotes + compounds)
    return {
        "edges": f"^{edge}+|{edge}+$",
        "breaks": character_class(punctuation + quotes) + "+",
        "clitics": character_class(clitics),
        "compounds": character_class(compounds),
    }


def nested_text(lists: Column, inner: str = " ", outer: str = ", ") -> Column:
    """A list of lists as one text."""
    return F.array_join(F.transform(lists, lambda x: F.array_join(x, inner)), outer)


def loaded_at() -> Column:
    """The time of the query, one for all its rows."""
    return F.current_timestamp()


def fold_case(text: Column) -> Column:
    """Lower case; a dotted capital I leaves no combining dot behind."""
    return F.replace(F.lower(text), F.lit("i̇"), F.lit("i"))


def tokens(text: Column) -> Column:
    """Lower-cased words between break characters, hyphens and apostrophes kept; null gives none."""
    return F.array_remove(F.split(fold_case(F.coalesce(text, F.lit(""))), BREAKS), "")


def nfkc(text: Column) -> Column:
    """NFKC form (Spark has no such function; Arrow batches)."""

    @F.pandas_udf("string")
    def normalize(s: pd.Series) -> pd.Series:
        return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")

    return normalize(text)


def is_bracketed(word: Column) -> Column:
    """A word wholly inside one pair of brackets."""
    pairs = "|".join(f"{re.escape(a)}[^{re.escape(b)}]+{re.escape(b)}" for a, b in BRACKETS)
    return F.coalesce(word.rlike(f"^(?:{pairs})$"), F.lit(False))


def word_class(word: Column, special: dict[str, str] | None = None) -> Column:
    """The class word that stands for special words, brackets and the like; others stay."""
    out = F.when(is_bracketed(word), F.lit("[bracketed]"))
    for name, stands_for in (special or {"<s>": "<unk>", "</s>": "<unk>"}).items():
        out = F.when(word == name, F.lit(stands_for)).otherwise(out)
    return F.coalesce(out, word)


def graphemes(word: Column, known: Column | None = None, unknown: str = "<unk>") -> Column:
    """Letters of a word; those outside ``known`` (an array) become the unknown symbol."""
    letters = F.filter(F.split(word, ""), lambda x: x != "")
    if known is None:
        return letters
    return F.transform(letters, lambda x: F.when(F.array_contains(known, x), x).otherwise(F.lit(unknown)))


def strip_cutoff(word: Column) -> Column:
    """``<cutoff-x>`` as x."""
    return F.regexp_replace(word, r"^<cutoff-(.*)>$", "$1")


def attach_cutoffs(words: Column) -> Column:
    """``<cutoff>`` followed by a plain word takes that word's name."""
    return F.transform(
        words,
        lambda x, i: F.when(
            (x == "<cutoff>") & F.get(words, i + 1).isNotNull() & ~F.coalesce(F.get(words, i + 1).startswith("<"), F.lit(True)),
            F.concat(F.lit("<cutoff-"), F.get(words, i + 1), F.lit(">")),
        ).otherwise(x),
    )


def human_list(items: Column) -> Column:
    """``a``, ``a and b``, ``a, b, and c``."""
    n = F.size(items)
    many = F.concat(F.array_join(F.slice(items, 1, n - 1), ", "), F.lit(", and "), F.element_at(items, -1))
    return (
        F.when(n == 0, "").when(n == 1, F.get(items, 0)).when(n == 2, F.array_join(items, " and ")).otherwise(many)
    )


#: What stands for a space inside a field of a table file.
ESCAPED_SPACE = "_SPACE_"


def escape_scp(value: Column, mark: str = ESCAPED_SPACE) -> Column:
    return F.replace(value, F.lit(" "), F.lit(mark))


def unescape_scp(value: Column, mark: str = ESCAPED_SPACE) -> Column:
    return F.replace(value, F.lit(mark), F.lit(" "))


def simple_words(text: str, vocabulary: frozenset[str] = frozenset()) -> list[str]:
    """Words of one transcript with brackets, quotes, clitics and compounds understood.

    A compound or clitic is split only where a part is in the vocabulary and the whole is not.
    """
    text = unicodedata.normalize("NFKC", text).lower().replace("i̇", "i")
    for mark in CLITICS:
        text = text.replace(mark, "'")
    for opening, closing in BRACKETS:
        inside = re.compile(f"{re.escape(opening)}[^{re.escape(closing)}]*{re.escape(closing)}")
        text = inside.sub(lambda m: re.sub(r"[\s-]+", "_", m[0]), text)
    out = []
    for word in text.split():
        if any(word.startswith(a) and word.endswith(b) and len(word) > 2 for a, b in BRACKETS):
            out.append(word)
            continue
        word = word.strip(PUNCTUATION + QUOTES + "-")
        parts = re.split(f"[{re.escape(PUNCTUATION + QUOTES)}]+", word)
        for part in filter(None, parts):
            out += split_clitics(part, vocabulary)
    return out


def split_clitics(word: str, vocabulary: frozenset[str]) -> list[str]:
    """Parts of a compound or clitic word if the vocabulary gains from the split."""
    if word in vocabulary or not vocabulary:
        return [word]
    pieces = [p for p in word.split("-") if p]
    out: list[str] = []
    for piece in pieces:
        if piece in vocabulary or "'" not in piece:
            out.append(piece)
            continue
        cut = re.findall(r"[^']+'?|'", piece)
        out += cut if any(c in vocabulary for c in cut) else [piece]
    return out if any(p in vocabulary for p in out) and len(out) > 1 else [word]


def simple_tokens(text: Column, vocabulary: frozenset[str] = frozenset()) -> Column:
    """simple_words over a column (Arrow batches); the vocabulary travels with the function."""

    @F.pandas_udf("array<string>")
    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda x: simple_words(x or "", vocabulary))

    return cut(text)


#: Tokenizers by name; others, as for scripts without spaces, are registered here by their users.
TOKENIZERS = {"words": tokens, "simple": simple_tokens, "letters": graphemes}


def register_tokenizer(name: str, function) -> None:
    """Makes a function from a text column to a column of word arrays known under a name."""
    TOKENIZERS[name] = function


def tokenized(text: Column, name: str = "words", **options) -> Column:
    if name not in TOKENIZERS:
        raise ValueError(f"no tokenizer is called {name}: {sorted(TOKENIZERS)}")
    return TOKENIZERS[name](text, **options)
