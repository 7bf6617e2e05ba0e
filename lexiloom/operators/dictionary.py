"""Dictionaries: special words, symbol tables, merging, lookups, phone classes, validation and normalisation with one."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.edit import token_edits
from ..functions.text import is_bracketed, simple_words
from ..session import checkpoint_folder
from .corpus import dense_ids

# fixed values: words and phones that every dictionary has
SPECIAL_WORDS = (("<eps>", "silence", "sil"), ("<unk>", "oov", "spn"), ("[bracketed]", "bracketed", "spn"), ("<cutoff>", "cutoff", "spn"), ("[laughter]", "laughter", "spn"))
RESERVED_PHONES = (("<eps>", "extra"), ("sil", "silence"), ("spn", "oov"))
# fixed values: classes of the phonetic alphabet
PHONE_CLASSES = {
    "bilabial": "p b m ɸ β ʙ", "labiodental": "f v ɱ ʋ", "dental": "θ ð", "alveolar": "t d n s z r ɾ l ɹ ɬ ɮ", "postalveolar": "ʃ ʒ",
    "retroflex": "ʈ ɖ ɳ ʂ ʐ ɻ ɭ ɽ", "palatal": "c ɟ ɲ ç ʝ j ʎ", "velar": "k ɡ ŋ x ɣ ɰ ʟ", "uvular": "q ɢ ɴ χ ʁ ʀ", "pharyngeal": "ħ ʕ", "glottal": "ʔ h ɦ",
    "stop": "p b t d ʈ ɖ c ɟ k ɡ q ɢ ʔ", "nasal": "m ɱ n ɳ ɲ ŋ ɴ", "trill": "ʙ r ʀ", "tap": "ɾ ɽ", "approximant": "ʋ ɹ ɻ j ɰ w", "lateral": "l ɭ ʎ ʟ ɬ ɮ",
    "fricative": "ɸ β f v θ ð s z ʃ ʒ ʂ ʐ ç ʝ x ɣ χ ʁ ħ ʕ h ɦ", "close": "i y ɨ ʉ ɯ u ɪ ʏ ʊ", "mid": "e ø ɘ ɵ ɤ o ə ɛ œ ɜ ɞ ʌ ɔ", "open": "æ a ɶ ɐ ɑ ɒ",
    "front": "i y ɪ ʏ e ø ɛ œ æ a ɶ", "central": "ɨ ʉ ɘ ɵ ə ɜ ɞ ɐ", "back": "ɯ u ʊ ɤ o ʌ ɔ ɑ ɒ", "rounded": "y ʉ u ʏ ʊ ø ɵ o œ ɞ ɔ ɶ ɒ",
}
DIACRITIC_CLASSES = {"long": "ː", "aspirated": "ʰ", "palatalized": "ʲ", "labialized": "ʷ", "nasalized": "̃", "ejective": "ʼ", "syllabic": "̩"}


def phone_classes(phones: DataFrame) -> DataFrame:
    """phone, class for every class that a phone's base letter or marks put it in; a few phones, so classes are columns."""
    base, found = F.substring("phone", 1, 1), []
    for name, members in PHONE_CLASSES.items():
        found.append(F.when(base.isin(*members.split()), F.lit(name)))
    for name, mark in DIACRITIC_CLASSES.items():
        found.append(F.when(F.col("phone").contains(mark), F.lit(name)))
    rows = phones.select("phone", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("class"))
    return rows.distinct()


def with_special_words(lexicon: DataFrame) -> DataFrame:
    """lexicon (word, phones) with word_type and the words that every dictionary has; entries of their names are dropped."""
    spark = lexicon.sparkSession
    special = spark.createDataFrame([(w, [p], k) for w, k, p in SPECIAL_WORDS], "word string, phones array<string>, word_type string")
    plain = lexicon.where(~F.col("word").isin(*(w for w, _, _ in SPECIAL_WORDS)))
    return plain.select("word", "phones", F.lit("speech").alias("word_type")).unionByName(special)


def load(entries: DataFrame, inventory: list[str] | None = None, lower: bool = True) -> DataFrame:
    """Entries (word, phones, ...) as a dictionary takes them: lower case, none without phones, none with phones outside the inventory, no repeats."""
    rows = entries.withColumn("word", F.lower("word")) if lower else entries
    rows = rows.where((F.size("phones") > 0) & ~F.col("word").rlike(r"\s") & (F.col("word") != ""))
    if inventory is not None:
        rows = rows.where(known_phones(F.col("phones"), F.array(*map(F.lit, inventory))))
    return rows.dropDuplicates(["word", "phones"])


def known_phones(phones: Column, inventory: Column) -> Column:
    """Whether every phone is in the inventory."""
    return F.forall(phones, lambda p: F.array_contains(inventory, p))


def phone_table(lexicon: DataFrame, disambiguation: int = 3) -> DataFrame:
    """phone, type, id: reserved phones, then the lexicon's in order, then disambiguation symbols."""
    spark = lexicon.sparkSession
    rows = [(k, 0, p, t) for k, (p, t) in enumerate(RESERVED_PHONES)]
    rows += [(k, 2, f"#{k}", "disambiguation") for k in range(disambiguation)]
    fixed = spark.createDataFrame(rows, "k long, part int, phone string, type string")
    own = lexicon.select(F.explode("phones").alias("phone")).distinct().where(~F.col("phone").isin(*(p for p, _ in RESERVED_PHONES)))
    own = own.select(F.lit(0).cast("long").alias("k"), F.lit(1).alias("part"), "phone", F.lit("non_silence").alias("type"))
    return dense_ids(fixed.unionByName(own), "part", "k", "phone").select("phone", "type", "id")


def add_words(target: DataFrame, source: DataFrame, key: list[str]) -> DataFrame:
    """target and the entries of source whose key it lacks, every one of them."""
    return target.unionByName(source.join(target.select(*key).distinct(), key, "left_anti").select(*target.columns))


def word_pronunciations(words: DataFrame, pronunciations: DataFrame) -> DataFrame:
    """Distinct (word, pronunciation), null for words without one."""
    return words.select("word").join(pronunciations.select("word", "pronunciation"), "word", "left").distinct()


def lookup_ids(rows: DataFrame, table: DataFrame, key: list[str], unknown: int) -> DataFrame:
    """rows with the id of their key from a symbol table, else the unknown id."""
    return rows.join(table.select(*key, "id"), key, "left").withColumn("id", F.coalesce("id", F.lit(unknown)))


def cutoff_completions(cutoffs: DataFrame, words: DataFrame, longest: int = 64) -> DataFrame:
    """cutoff, word: the words that a cut-off piece begins, by an equality join on prefixes of up to ``longest`` letters."""
    piece = F.regexp_extract("word", "^<cutoff-(.*)>$", 1)
    asked = cutoffs.select(F.col("word").alias("cutoff"), piece.alias("_p")).where("_p <> ''")
    sizes = F.sequence(F.lit(1), F.least(F.length("word"), F.lit(longest)))
    begun = words.where("length(word) > 0").select("word", F.explode(F.transform(sizes, lambda k: F.substring(F.col("word"), F.lit(1), k))).alias("_p"))
    short = asked.join(begun, "_p").select("cutoff", "word")
    rest = asked.where(F.length("_p") > longest)  # longer pieces meet under their first letters
    far = rest.withColumn("_h", F.substring("_p", 1, longest)).join(begun.where(F.length("_p") == longest).withColumnRenamed("_p", "_h"), "_h")
    return short.unionByName(far.where(F.startswith("word", "_p")).select("cutoff", "word"))


def pruned(pronunciations: DataFrame, count: str, share: float) -> tuple[DataFrame, DataFrame]:
    """(pronunciations used at least ``share`` as often as the word's most frequent one, numbers before and after by dictionary)."""
    top = F.max(count).over(Window.partitionBy("dictionary", "word"))
    marked = pronunciations.withColumn("_keep", F.col(count) >= share * top)
    sizes = marked.groupBy("dictionary").agg(F.count("*").alias("n_before"), F.sum(F.col("_keep").cast("long")).alias("n_after"))
    return marked.where("_keep").drop("_keep"), sizes


def merged_probabilities(entries: DataFrame, numbers: tuple[str, ...]) -> DataFrame:
    """One entry a word and pronunciation of all dictionaries, its numbers averaged."""
    return entries.groupBy("word", "pronunciation").agg(*(F.avg(x).alias(x) for x in numbers), F.count("*").alias("n_dictionaries"))


def validated(given: DataFrame, generated: DataFrame) -> DataFrame:
    """word, pronunciation, generated, edits: each given pronunciation beside the nearest generated one."""
    rows = given.select("word", "pronunciation").join(generated.select("word", F.col("pronunciation").alias("generated")), "word", "left")
    split = lambda c: F.split(F.coalesce(F.col(c), F.lit("")), " ")
    rows = rows.withColumn("edits", token_edits(split("pronunciation"), split("generated")))
    best = F.min_by(F.struct("generated", "edits"), F.struct("edits", "generated")).alias("_b")
    return rows.groupBy("word", "pronunciation").agg(best).select("word", "pronunciation", "_b.generated", "_b.edits")


def normalized(rows: DataFrame, text: str, vocabulary: frozenset[str], oov: str = "<unk>") -> DataFrame:
    """rows with normalized_text (words, brackets as their class), character_text, and oovs (sorted, without repeats).

    The vocabulary travels with the function; ``out_of_vocabulary`` is the way for one that is too large for that.
    """

    @F.pandas_udf("normalized_text string, character_text string, oovs array<string>")
    def cut(s: pd.Series) -> pd.DataFrame:
        out = []
        for value in s:
            words = simple_words(value or "", vocabulary)
            shown = ["[bracketed]" if w[:1] in "[{<(" and len(w) > 2 else w for w in words]
            missing = sorted({w for w, x in zip(words, shown, strict=True) if w == x and w not in vocabulary})
            letters = " ".join("<space>" if c == " " else c for c in " ".join(w if w in vocabulary else oov for w in shown))
            out.append((" ".join(shown), letters, missing))
        return pd.DataFrame(out, columns=["normalized_text", "character_text", "oovs"])

    return rows.withColumn("_n", cut(text)).select(*rows.columns, "_n.*")


def sex_counts(speakers: DataFrame, sex: str) -> DataFrame:
    """n_female, n_male, n_unspecified by the first letter."""
    first = F.lower(F.substring(F.coalesce(F.trim(sex), F.lit("")), 1, 1))
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return speakers.agg(count(first == "f").alias("n_female"), count(first == "m").alias("n_male"), count(~first.isin("f", "m")).alias("n_unspecified"))


def bracketed_types(counts: DataFrame) -> DataFrame:
    """Token totals by type for a model's description: speech, bracketed and out of vocabulary (column known)."""
    kind = F.when(is_bracketed(F.col("word")), "bracketed").when(F.col("known"), "speech").otherwise("oov")
    n = lambda name: F.coalesce(F.sum(F.when(kind == name, F.col("n"))), F.lit(0)).alias(f"n_{name}")
    return counts.agg(n("speech"), n("oov"), n("bracketed"))


#: Endings that make a word of another, with what they may have replaced.
ENDINGS = (("ability", ("able",)), ("ably", ("able",)), ("ness", ("",)), ("less", ("",)), ("able", ("", "e")), ("ing", ("", "e")), ("ly", ("", "le")), ("ed", ("", "e")), ("es", ("", "e")), ("s", ("",)))
BEGINNINGS = ("non", "un", "re", "pre", "anti", "multi", "under", "over", "super", "semi")


def _stems(word: Column) -> Column:
    """Array of (rank, base, parts) of a word: itself, and each stem that one of ENDINGS leaves, in order of preference."""
    entry = lambda fits, rank, base, parts: F.when(fits, F.struct(F.lit(rank).alias("rank"), base.alias("base"), parts.alias("parts")))
    found, rank = [entry(F.lit(True), 0, word, F.array(word))], 0
    for ending, olds in ENDINGS:
        n = F.length(word) - len(ending)
        stem = F.substring(word, F.lit(1), n)
        fits = F.endswith(word, F.lit(ending)) & (n > 1)
        shorter = F.substring(word, F.lit(1), n - 1)
        options = [(fits, F.concat(stem, F.lit(old))) for old in olds]
        options.append((fits & (n > 2) & (F.substring(word, n, F.lit(1)) == F.substring(word, n - 1, F.lit(1))), shorter))  # a doubled letter
        options.append((fits & F.endswith(stem, F.lit("i")), F.concat(shorter, F.lit("y"))))
        for condition, base in options:
            rank += 1
            found.append(entry(condition, rank, base, F.array(base, F.lit(f"+{ending}"))))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def _known_stems(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """word, parts of the words of which some stem is in the vocabulary; the first in order of preference."""
    flat = words.select("word", F.inline(_stems(F.col("word"))))
    known = flat.join(vocabulary.select(F.col("word").alias("base")).distinct(), "base", "left_semi")
    return known.groupBy("word").agg(F.min_by("parts", "rank").alias("parts"))


def split_affixes(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """word, parts of every different word: known words as they are, others as a known stem and its affixes (``walk +ing``, ``un+ do``).

    Endings come before beginnings, both in the order of their tables; several beginnings may stand before a stem. Where no split is known the word is its own part. Candidates meet
    the vocabulary (column word) in a join, so it may be of any size. There is one round for each beginning that words stack up.
    """
    checkpoint_folder(words.sparkSession)
    open_ = words.where("word IS NOT NULL").select("word").distinct().withColumns({"_rest": F.col("word"), "_path": F.array().cast("array<int>"), "_front": F.array().cast("array<string>")}).checkpoint()
    all_words, done = open_.select("word"), None
    while not open_.isEmpty():
        stems = _known_stems(open_.select(F.col("_rest").alias("word")).distinct(), vocabulary).withColumnRenamed("word", "_rest")
        joined = open_.join(stems, "_rest", "left").checkpoint()
        found = joined.where("parts IS NOT NULL").select("word", "_path", F.concat("_front", "parts").alias("parts"))
        done = found if done is None else done.unionByName(found)
        cut = [
            F.when(F.startswith(F.col("_rest"), F.lit(b)), F.struct(F.lit(k).alias("k"), F.lit(f"{b}+").alias("b"), F.regexp_replace(F.substring("_rest", F.lit(len(b) + 1), F.length("_rest")), "^-", "").alias("r")))
            for k, b in enumerate(BEGINNINGS)
        ]
        fresh = joined.where("parts IS NULL").select("word", "_path", "_front", F.inline(F.filter(F.array(*cut), lambda x: x.isNotNull())))
        fresh = fresh.where("r <> ''").select("word", F.col("r").alias("_rest"), F.array_append("_path", F.col("k")).alias("_path"), F.array_append("_front", F.col("b")).alias("_front"))
        open_ = fresh.checkpoint()
    if done is None:
        return all_words.select("word", F.array("word").alias("parts"))
    best = done.groupBy("word").agg(F.min_by("parts", "_path").alias("parts"))
    return all_words.join(best, "word", "left").select("word", F.coalesce("parts", F.array("word")).alias("parts"))
