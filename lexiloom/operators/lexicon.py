"""Pronunciation lexicons: reading, rules, prefixes, remapping and estimated probabilities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import correction, probability
from ..session import checkpoint_folder
from .corpus import dense_ids, explode_words, totals_before

FIELDS = ("probability", "silence_after", "silence_before_correction", "nonsilence_before_correction")


def parse_lines(lines: DataFrame) -> DataFrame:
    """word, up to four numbers and phones from lines ``word [p [s [c c]]] phone...`` (column value).

    Leading fields that look like probabilities are taken as long as they do, four at most; lines
    without a phone are dropped.
    """
    parts = F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != "")
    rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    number = lambda x: x.rlike(r"^(\d+\.\d+|1)$")
    n = F.lit(0)
    for k in range(4, 0, -1):
        head = F.slice(rest, 1, k)
        n = F.when((n == 0) & (F.size(head) == k) & F.forall(head, number), k).otherwise(n)
    rows = lines.select(F.get(parts, 0).alias("word"), rest.alias("_rest"), n.alias("_n")).where("size(_rest) > _n")
    return rows.select(
        "word",
        *(F.when(F.col("_n") > k, F.get("_rest", k).cast("double")).alias(name) for k, name in enumerate(FIELDS)),
        F.expr("slice(_rest, _n + 1, size(_rest) - _n)").alias("phones"),
    )


#: What is written for an unknown number that stands before a known one.
UNKNOWN = dict(zip(FIELDS, (0.99, 0.5, 1.0, 1.0), strict=True))


def lexicon_lines(lexicon: DataFrame) -> Column:
    """A line for each entry: word, its numbers up to the last that is known, phones.

    A field's place tells what it is, so an unknown number before a known one is written as UNKNOWN has it.
    """
    numbers = []
    for k, name in enumerate(FIELDS):
        later = F.coalesce(*(F.col(x) for x in FIELDS[k:])).isNotNull()
        numbers.append(F.when(later, F.coalesce(F.col(name), F.lit(UNKNOWN[name]))).cast("string"))
    return F.concat_ws("\t", "word", *numbers, F.array_join("phones", " "))


def rule_pattern(segment: str, before: str, after: str) -> str:
    """Pattern of a rule over a space-joined pronunciation with a space at both ends."""
    front = "^ " if before == "^" else f"(?<= {before} )" if before else "(?<= )"
    back = "(?= $)" if after == "$" else f"(?= {after} )" if after else "(?= )"
    return f"{front}{segment}{back}"


def apply_rule(pronunciation: Column, segment: str, before: str, after: str, replacement: str) -> Column:
    """The pronunciation with the rule applied everywhere."""
    padded = F.concat(F.lit(" "), pronunciation, F.lit(" "))
    front = " " if before == "^" else ""
    out = F.regexp_replace(padded, rule_pattern(segment, before, after), front + replacement)
    return F.trim(F.regexp_replace(out, " +", " "))


def expand_rules(
    lexicon: DataFrame, rules: Sequence[tuple[str, str, str, str]], inventory: Sequence[str] | None = None, growth: int = 4, least_limit: int = 16
) -> DataFrame:
    """Closure of a lexicon (word, pronunciation) under rules (segment, before, after, replacement), with where each variant comes from.

    Returns word, pronunciation, generated, rules (the numbers of all rules on the path to it, rising), depth (length of the path, 0 for
    given entries) and endless. Of several paths to a variant the shortest counts, of those the one of the smallest rule numbers in
    order. Variants that are empty or have phones outside the inventory are left out, as are those of more than ``growth`` times
    the phones of the entry that they come from (and over ``least_limit``): rules that feed themselves stop there, and all rows of that word are marked endless;
    other words aren't touched. Null pronunciations are dropped, repeated entries count once.

    Each round applies every rule to the variants that the round before found and keeps what the word doesn't have yet
    (semi-naive), so there are as many rounds as the longest path has rules. Rounds are checkpointed; only their row counts reach the driver.
    """
    checkpoint_folder(lexicon.sparkSession)
    phones = lambda c: F.size(F.split(c, " "))
    limit = F.greatest(growth * phones(F.col("pronunciation")), F.lit(least_limit))
    given = lexicon.where("pronunciation IS NOT NULL").select("word", "pronunciation").distinct()
    fresh = given.select("word", "pronunciation", F.array().cast("array<int>").alias("path"), limit.alias("_most")).checkpoint()
    found, endless = fresh, given.select("word").limit(0)
    made = [F.struct(F.lit(k).alias("k"), apply_rule(F.col("pronunciation"), *rule).alias("p")) for k, rule in enumerate(rules)]
    while rules and not fresh.isEmpty():
        steps = fresh.select("word", "pronunciation", "path", "_most", F.inline(F.array(*made)))
        steps = steps.where((F.col("p") != F.col("pronunciation")) & (F.col("p") != ""))
        if inventory is not None:
            steps = steps.where(F.size(F.array_except(F.split("p", " "), F.array(*map(F.lit, inventory)))) == 0)
        steps = steps.select("word", F.col("p").alias("pronunciation"), F.array_append("path", F.col("k")).alias("path"), "_most")
        steps = steps.join(found.select("word", "pronunciation"), ["word", "pronunciation"], "left_anti")
        steps = steps.groupBy("word", "pronunciation").agg(F.min("path").alias("path"), F.min_by("_most", "path").alias("_most")).checkpoint()
        short = phones(F.col("pronunciation")) <= F.col("_most")
        endless = endless.unionByName(steps.where(~short).select("word"))
        fresh = steps.where(short)
        found = found.unionByName(fresh)
    marks = endless.distinct().withColumn("endless", F.lit(True))
    return found.join(marks, "word", "left").select(
        "word", "pronunciation", (F.size("path") > 0).alias("generated"), F.array_sort(F.array_distinct("path")).alias("rules"),
        F.size("path").alias("depth"), F.coalesce("endless", F.lit(False)).alias("endless"),
    )


def rule_applications(expanded: DataFrame) -> DataFrame:
    """rule, word, pronunciation: one row for each rule on the path to each generated variant of expand_rules()."""
    return expanded.where("generated").select(F.explode("rules").alias("rule"), "word", "pronunciation")


def prefixes(phones: Column) -> Column:
    """All prefixes of an array, the shortest first."""
    return F.when(F.size(phones) > 0, F.transform(F.sequence(F.lit(1), F.size(phones)), lambda k: F.slice(phones, 1, k))).otherwise(
        F.array().cast("array<array<string>>")
    )


def remap_alternatives(lexicon: DataFrame, mapping: dict[str, list[str]], phones: Sequence[str] | None = None) -> DataFrame:
    """lexicon (word, phones, numbers of FIELDS that it has) with each phone replaced by each of its alternatives.

    Entries of a word that become equal are merged: the largest probability stays, of the other numbers the mean of those that are known, and
    ``n`` counts them. With ``phones`` given, entries that hold a phone neither mapped nor among them are left out.
    """
    table = F.create_map(*(x for k, v in mapping.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    if phones is not None:
        lexicon = lexicon.where(F.forall("phones", lambda p: p.isin(*mapping, *phones)))
    choices = F.transform("phones", lambda p: F.coalesce(F.try_element_at(table, p), F.array(p)))
    start = F.array(F.array().cast("array<string>"))
    product = F.aggregate(
        choices, start, lambda done, options: F.flatten(F.transform(done, lambda d: F.transform(options, lambda o: F.array_append(d, o))))
    )
    numbers = [c for c in FIELDS if c in lexicon.columns]
    rows = lexicon.select("word", *numbers, F.explode(product).alias("phones"))
    merged = [(F.max if c == "probability" else F.avg)(c).alias(c) for c in numbers]
    return rows.groupBy("word", "phones").agg(*merged, F.count("*").alias("n"))


def pronunciation_counts(rows: DataFrame, key: list[str], order: str, silence: Column) -> DataFrame:
    """word, n, sil_after, non_after, sil_before, non_before over sequences of word rows.

    Silence rows aren't words; a word's neighbour is the row next to it, and the edges count as silence.
    """
    w = Window.partitionBy(*key).orderBy(order)
    marked = rows.withColumn("_sil", silence)
    after = F.coalesce(F.lead("_sil").over(w), F.lit(True))
    before = F.coalesce(F.lag("_sil").over(w), F.lit(True))
    marked = marked.select("word", "_sil", after.alias("_after"), before.alias("_before")).where("NOT _sil")
    count = lambda c: F.sum(c.cast("long"))
    return marked.groupBy("word").agg(
        F.count("*").alias("n"),
        count(F.col("_after")).alias("sil_after"),
        count(~F.col("_after")).alias("non_after"),
        count(F.col("_before")).alias("sil_before"),
        count(~F.col("_before")).alias("non_before"),
    )


def pronunciation_pairs(rows: DataFrame, key: list[str], order: str, silence: Column) -> DataFrame:
    """previous, word, silence, n: pairs of words that follow each other, by whether silence lies between them."""
    w = Window.partitionBy(*key).orderBy(order)
    marked = rows.withColumn("_sil", silence)
    marked = marked.withColumn("silence", F.coalesce(F.lag("_sil").over(w), F.lit(True)))
    words = marked.where("NOT _sil").withColumn("previous", F.lag("word").over(w))
    return words.where("previous IS NOT NULL").groupBy("previous", "word", "silence").agg(F.count("*").alias("n"))


def pronunciation_probabilities(counts: DataFrame, group: str) -> DataFrame:
    """Written probabilities from counts, one added to each and scaled by the largest of the group."""
    share = F.col("_sb") / (F.col("_sb") + F.col("_nb"))
    sums = counts.agg(F.sum("sil_before").alias("_sb"), F.sum("non_before").alias("_nb"))
    rows = counts.crossJoin(sums).withColumn("_p", share)  # one row of sums
    largest = F.max(F.col("n") + 1).over(Window.partitionBy(group))
    after = (F.col("sil_after") + 2 * F.col("_p")) / (F.col("sil_after") + F.col("non_after") + 2)
    rows = rows.withColumns({"_prob": (F.col("n") + 1) / largest, "_after": after})
    return rows.select(
        group, "word", "n", probability(F.col("_prob")).alias("probability"), probability(F.col("_after")).alias("silence_after")
    )


def before_corrections(counts: DataFrame, pairs: DataFrame, silence_after: DataFrame) -> DataFrame:
    """Corrections of the silence before a word, from word pairs (previous, word, n) and silence_after."""
    expected = pairs.join(silence_after.select(F.col("word").alias("previous"), "silence_after"), "previous", "left")
    s = F.coalesce("silence_after", F.lit(0.01))
    expected = expected.groupBy("word").agg(F.sum(F.col("n") * s).alias("_s"), F.sum(F.col("n") * (1 - s)).alias("_n"))
    rows = counts.join(expected, "word", "left").fillna(0, ["_s", "_n"])
    return rows.select(
        "word",
        correction((F.col("sil_before") + 2) / (F.col("_s") + 2)).alias("silence_before_correction"),
        correction((F.col("non_before") + 2) / (F.col("_n") + 2)).alias("nonsilence_before_correction"),
    )


def matching_rules(pronunciations: DataFrame, rules: list[tuple[str, str, str, str]]) -> DataFrame:
    """pronunciations with each rule (number) that matches and what it makes of them: rule, applied.

    Rules are a short list on the driver, so they become columns and no join is needed.
    """
    padded = F.concat(F.lit(" "), F.col("pronunciation"), F.lit(" "))
    found = [
        F.when(
            padded.rlike(rule_pattern(segment, before, after)),
            F.struct(F.lit(k).alias("rule"), apply_rule(F.col("pronunciation"), segment, before, after, replacement).alias("applied")),
        )
        for k, (segment, before, after, replacement) in enumerate(rules)
    ]
    rows = pronunciations.withColumn("_m", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())))
    return rows.select(*pronunciations.columns, "_m.rule", "_m.applied")


def rule_statistics(matched: DataFrame, used: DataFrame) -> DataFrame:
    """rule, n_matched, n_used, probability: how often what a rule makes (word, pronunciation) is in use."""
    hit = used.select("word", F.col("pronunciation").alias("applied"), F.lit(1).alias("_hit")).distinct()
    rows = matched.join(hit, ["word", "applied"], "left")
    counts = rows.groupBy("rule").agg(F.count("*").alias("n_matched"), F.coalesce(F.sum("_hit"), F.lit(0)).alias("n_used"))
    return counts.withColumn("probability", probability(F.col("n_used") / F.col("n_matched")))


def cutoff_entries(lexicon: DataFrame, counts: DataFrame, threshold: int = 1, unknown: str = "spn") -> DataFrame:
    """Entries of cut-off words: the unknown phone at 0.01 and every prefix at 0.99, included if frequent."""
    name = F.concat(F.lit("<cutoff-"), F.col("word"), F.lit(">"))
    seen = lexicon.join(counts.select("word", F.col("n").alias("_n")), "word", "left")
    included = F.coalesce(F.col("_n") > threshold, F.lit(False))
    made = seen.select(
        name.alias("word"), included.alias("included"),
        F.explode(F.concat(
            F.array(F.struct(F.lit(unknown).alias("pronunciation"), F.lit(0.01).alias("probability"))),
            F.transform(prefixes(F.col("phones")), lambda p: F.struct(F.array_join(p, " ").alias("pronunciation"), F.lit(0.99).alias("probability"))),
        )).alias("_e"),
    )
    return made.select("word", "_e.pronunciation", "_e.probability", "included").distinct()


def first_pronunciations(lexicon: DataFrame, *order: str) -> DataFrame:
    """One entry a word, the first in order: the dictionary of speakers of no single dialect."""
    rest = [c for c in lexicon.columns if c != "word"]
    first = lexicon.groupBy("word").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_f"))
    return first.select("word", *(F.col(f"_f.{c}").alias(c) for c in rest))


def hold_out(words: DataFrame, letters: Column, share: Column) -> DataFrame:
    """words with ``held_out``: those that ``share`` picks, unless a letter of theirs is in no other word.

    The letters that only picked words have are few and go to all tasks as one row. Both passes read the words without a filter, so that they are made once.
    """
    rows = words.withColumns({"_letters": letters, "_picked": share})
    spread = rows.select("_picked", F.explode_outer("_letters").alias("_l")).where("_l IS NOT NULL")
    only = spread.groupBy("_l").agg(F.coalesce(F.bool_or(~F.col("_picked")), F.lit(False)).alias("_known")).where("NOT _known")
    unseen = only.agg(F.collect_list("_l").alias("_unseen"))  # one row
    back = F.exists("_letters", lambda x: x.isNull()) | F.coalesce(F.arrays_overlap("_letters", "_unseen"), F.lit(False))
    return rows.crossJoin(F.broadcast(unseen)).select(*words.columns, F.when(F.col("_picked"), ~F.coalesce(back, F.lit(False))).otherwise(F.col("_picked")).alias("held_out"))


def collect_alignments(rows: DataFrame, words: str, *key: str) -> tuple[DataFrame, DataFrame]:
    """(word rows, phone rows) of nested alignments: words is an array of (word, phones)."""
    w = rows.select(*key, F.posexplode(words).alias("word_index", "_w"))
    word_rows = w.select(*key, "word_index", F.col("_w.word").alias("word"))
    phones = w.select(*key, "word_index", F.posexplode("_w.phones").alias("phone_index", "phone"))
    return word_rows, phones


def numbered_alignments(rows: DataFrame, words: Column, vocabulary: DataFrame, *key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(word intervals, phone intervals, new words) of nested alignments (see collect_alignments), with ids.

    vocabulary: word, word_id. Words that it lacks are new words with the ids after its largest, in order of the word. Word intervals: id, key, word_index, word_id, from 0 in order of
    the key and index. Phone intervals: id, word_interval_id, word_id, phone_index, phone, numbered likewise.

    Only sizes are sorted: a row's first ids are the words and phones of the rows before it, and its words and phones count on from there. Rows of one key
    stand by their size.
    """
    phones_before = F.aggregate(words, F.array(F.lit(0).cast("long")), lambda at, w: F.concat(at, F.array(F.element_at(at, -1) + F.greatest(F.size(w["phones"]), F.lit(0)))))
    named = rows.withColumn("_key", F.struct(*key))  # nulls in keys are alike
    sizes = named.select("_key", phones_before.alias("_b")).select("_key", (F.size("_b") - 1).cast("long").alias("_n"), F.element_at("_b", -1).alias("_m")).where("_n > 0")
    firsts = totals_before(sizes.select("*", F.col("_n").alias("_word"), F.col("_m").alias("_phone")), ["_word", "_phone"], "_key", "_n", "_m")
    firsts = firsts.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("_n", "_m", "_word", "_phone"))).alias("_firsts"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number, as few bytes become many rows and such partitions aren't merged
    copy = F.row_number().over(Window.partitionBy("_key").orderBy(F.size("_b"), F.element_at("_b", -1)))
    nested = named.repartition(parts, "_key").select("_key", *key, words.alias("_ws"), phones_before.alias("_b")).withColumn("_copy", copy).join(firsts, "_key")
    nested = nested.select(*key, F.get("_firsts", F.col("_copy") - 1).alias("_first"), "_ws", "_b")
    spread = nested.select(*key, "_first", "_b", F.posexplode_outer("_ws").alias("word_index", "_w")).where("word_index IS NOT NULL")
    word_rows = spread.select(
        (F.col("_first._word") + F.col("word_index")).alias("id"), *key, "word_index", F.col("_w.word").alias("word"), F.col("_w.phones").alias("_phones"),
        (F.col("_first._phone") + F.get("_b", "word_index")).alias("_phone"),
    )
    unknown = explode_words(rows, F.transform(words, lambda w: w["word"])).distinct().join(vocabulary.select("word"), "word", "left_anti")
    top = vocabulary.agg(F.coalesce(F.max("word_id"), F.lit(-1)).cast("long").alias("_top"))
    new = dense_ids(unknown, "word", name="_n").crossJoin(F.broadcast(top)).select("word", (F.col("_top") + 1 + F.col("_n")).alias("word_id"))  # one row
    names = vocabulary.select("word", F.col("word_id").cast("long").alias("word_id")).unionByName(new)
    known = word_rows.join(names, "word")
    phones = known.select("_phone", F.col("id").alias("word_interval_id"), "word_id", F.posexplode_outer("_phones").alias("phone_index", "phone")).where("phone_index IS NOT NULL")
    phones = phones.select((F.col("_phone") + F.col("phone_index")).alias("id"), "word_interval_id", "word_id", "phone_index", "phone")
    return known.select("id", *key, "word_index", "word_id"), phones, new
