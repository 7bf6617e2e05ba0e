"""Operators over utterances: words out of vocabulary, eligibility, summaries, table edits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import checkpoint_folder


def explode_words(rows: DataFrame, words: Column, *keep: str) -> DataFrame:
    """One row a word (words aren't null). The filter stands behind the explode, as before it the words would be made twice."""
    return rows.select(*keep, F.explode_outer(words).alias("word")).where("word IS NOT NULL")


def word_counts(rows: DataFrame, words: Column, *keys: str) -> DataFrame:
    """Occurrences of each word within the keys (partial counts before the shuffle)."""
    return explode_words(rows, words, *keys).groupBy(*keys, "word").agg(F.count("*").alias("n"))


def out_of_vocabulary(counts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Counted words that the vocabulary (column word) lacks."""
    return counts.join(vocabulary.select("word").distinct(), "word", "left_anti")


def typed_words(counts: DataFrame, vocabulary: DataFrame, threshold: int = 0) -> DataFrame:
    """word_type speech or oov, and included: known words seen more than ``threshold`` times."""
    known = vocabulary.select("word", F.lit(True).alias("_known")).distinct()
    joined = counts.join(known, "word", "left")
    speech = F.col("_known").isNotNull() & (F.col("n") > threshold)
    return joined.withColumns({"word_type": F.when(speech, "speech").otherwise("oov"), "included": speech}).drop("_known")


def without_tainted_groups(rows: DataFrame, tainted: DataFrame, group: str) -> DataFrame:
    """Rows of groups (files, speakers) that hold no tainted row at all."""
    return rows.join(tainted.select(group).distinct(), group, "left_anti")


def eligible(rows: DataFrame, words: Column, least_words: int, manual: Column, *quality: Column) -> DataFrame:
    """Rows with enough words whose quality conditions hold, are unknown, or that were made by hand."""
    keep = F.size(words) >= least_words
    for condition in quality:
        keep = keep & (F.coalesce(condition, F.lit(True)) | F.coalesce(manual, F.lit(False)))
    return rows.where(keep)


def merge_update(target: DataFrame, changes: DataFrame, key: str, columns: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """target with the given columns replaced where changes has the key and a value that isn't null.

    Of several changes to one key the last in ``order`` wins.
    """
    struct = F.struct(*columns)
    last = changes.groupBy(key).agg(F.max_by(struct, F.struct(*order)).alias("_new"))
    joined = target.join(last, key, "left")
    return joined.withColumns({c: F.coalesce(F.col(f"_new.{c}"), F.col(c)) for c in columns}).select(*target.columns)


def insert_or_ignore(target: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """target and those rows whose key it lacks, one a key."""
    fresh = rows.dropDuplicates(list(key)).join(target.select(*key), list(key), "left_anti")
    return target.unionByName(fresh.select(*target.columns))


def delete_matching(target: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return target.join(keys.select(*on).distinct(), list(on), "left_anti")


def replace_group(target: DataFrame, rows: DataFrame, group: str) -> DataFrame:
    """target with all rows of the groups in ``rows`` replaced by them."""
    return delete_matching(target, rows, [group]).unionByName(rows.select(*target.columns))


def orphans(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str) -> DataFrame:
    """Parents without a child."""
    return parents.join(children.select(F.col(child_key).alias(parent_key)), parent_key, "left_anti")


def lookup(rows: DataFrame, **wanted) -> DataFrame:
    """Rows that equal every given value; None means any."""
    for column, value in wanted.items():
        if value is not None:
            rows = rows.where(F.col(column) == F.lit(value))
    return rows


def lookup_joined(utterances: DataFrame, files: DataFrame, speakers: DataFrame, **wanted) -> DataFrame:
    """Utterances that equal every given value; tables of files and speakers are joined only where a wanted column is theirs.

    file_name and speaker_name are columns of those tables (file_id, file_name; speaker_id, speaker_name).
    """
    asked = {k: v for k, v in wanted.items() if v is not None}
    rows = utterances
    for table, key in ((files, "file_id"), (speakers, "speaker_id")):
        if mine := {k: v for k, v in asked.items() if k in table.columns and k not in utterances.columns}:
            rows = rows.join(lookup(table, **mine).select(key), key, "left_semi")
            asked = {k: v for k, v in asked.items() if k not in mine}
    return lookup(rows, **asked)


def summary(rows: DataFrame, group: Column, words: Column) -> DataFrame:
    """Utterances, speakers, words and characters of each group."""
    return rows.groupBy(group.alias("grp")).agg(
        F.count("*").alias("n_utterances"),
        F.countDistinct("source").alias("n_speakers"),
        F.sum(F.size(words)).cast("long").alias("n_words"),
        F.sum("n_chars").alias("n_chars"),
    )


def dense_ids(rows: DataFrame, *order: str, name: str = "id") -> DataFrame:
    """rows with ``name`` 0, 1, ... in order, numbered in range partitions and shifted by those before; a column of that name is replaced.

    The sorted rows are checkpointed first, so that counts and numbers come from one arrangement.
    """
    checkpoint_folder(rows.sparkSession)
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = sorted_.select("*", F.spark_partition_id().alias("_p"), place.alias("_k")).checkpoint()
    sizes = placed.groupBy("_p").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))  # one row a partition
    starts = sizes.select("_p", F.coalesce(before, F.lit(0)).alias("_start"))
    kept = [c for c in rows.columns if c != name]
    return placed.join(starts, "_p").select(*kept, (F.col("_start") + F.col("_k")).alias(name))


def totals_before(rows: DataFrame, values: Sequence[str], *order: str) -> DataFrame:
    """rows with each of the values (not null) replaced by its total over the rows before, in order; summed in range partitions and shifted by those before. Rows equal in order stand in any order.

    The sorted rows are checkpointed first, as in dense_ids.
    """
    checkpoint_folder(rows.sparkSession)
    place = {"_p": F.spark_partition_id(), "_k": F.monotonically_increasing_id()}
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns(place).checkpoint()
    sizes = placed.groupBy("_p").agg(*(F.sum(c).alias(c) for c in values))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = sizes.select("_p", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_start_{c}") for c in values))
    inner = Window.partitionBy("_p").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.withColumns({f"_inner_{c}": F.coalesce(F.sum(c).over(inner), F.lit(0)) for c in values}).join(starts, "_p")
    return summed.withColumns({c: F.col(f"_start_{c}") + F.col(f"_inner_{c}") for c in values}).select(*rows.columns)


def ranks_within(rows: DataFrame, group: str, *order: Column, name: str = "rank") -> DataFrame:
    """rows with their rank (from 0) within the group, in rising order; numbered over all groups in range partitions, so a large group isn't sorted in one task."""
    keys = {f"_order{k}": c for k, c in enumerate(order)}
    ids = dense_ids(rows.withColumns(keys), group, *keys, name="_place")
    first = ids.groupBy(F.col(group).alias("_group")).agg(F.min("_place").alias("_first"))
    joined = ids.join(first, F.col(group).eqNullSafe(F.col("_group")))
    return joined.select(*rows.columns, (F.col("_place") - F.col("_first")).alias(name))


def job_ranges(ids: DataFrame, jobs: int) -> DataFrame:
    """rows (with dense id) dealt to jobs in contiguous ranges, sizes differing by one at most."""
    total = ids.agg(F.count("*").alias("_n"))
    return ids.crossJoin(total).withColumn("job", F.floor(F.col("id") * jobs / F.col("_n"))).drop("_n")  # one row


def in_subset(lexicon: DataFrame, words: DataFrame) -> DataFrame:
    """lexicon with ``included``: whether the subset's words (column word) hold the entry."""
    seen = words.select("word").distinct().withColumn("_seen", F.lit(True))
    return lexicon.join(seen, "word", "left").withColumn("included", F.col("_seen").isNotNull()).drop("_seen")


def unknown_words(rows: DataFrame, words: Column, vocabulary: DataFrame, *keep: str) -> DataFrame:
    """keep, word: one row for each word of a text that the vocabulary (column word) lacks, repeats included."""
    return explode_words(rows, words, *keep).join(vocabulary.select("word").distinct(), "word", "left_anti").select(*keep, "word")


def with_unknown_words(rows: DataFrame, words: Column, vocabulary: DataFrame, id: str, name: str = "oovs") -> DataFrame:
    """rows with the words that the vocabulary (column word) lacks, in their order and joined by spaces; empty where there are none.

    Only the known words of each id are moved; a text's words are held against them where the text is.
    """
    known = explode_words(rows, F.array_distinct(words), id).join(vocabulary.select("word").distinct(), "word", "left_semi")
    listed = known.groupBy(F.col(id).alias("_id")).agg(F.collect_set("word").alias("_known"))
    joined = rows.join(listed, F.col(id).eqNullSafe(F.col("_id")), "left")
    unknown = F.filter(words, lambda x: F.col("_known").isNull() | ~F.array_contains("_known", x))
    return joined.withColumn(name, F.coalesce(F.array_join(unknown, " "), F.lit(""))).drop("_id", "_known")


def replace_by_segments(utterances: DataFrame, segments: DataFrame, id: str, order: str) -> DataFrame:
    """utterances of which those with segments are gone and their segments stand instead, with ids after the largest one.

    segments: id (of the utterance), order and whatever columns of the utterances they change; other columns are the utterance's. New ids rise with id and order.
    """
    numbered = dense_ids(segments, id, order, name="_new")
    top = utterances.agg(F.coalesce(F.max(id), F.lit(-1)).cast("long").alias("_top"))
    changed = [c for c in segments.columns if c not in (id, order)]
    old = utterances.drop(*changed)
    made = numbered.join(old, id).crossJoin(F.broadcast(top)).withColumn(id, F.col("_top") + 1 + F.col("_new"))  # one row
    kept = utterances.join(segments.select(id).distinct(), id, "left_anti")
    return kept.unionByName(made.select(*utterances.columns))


def rename_speakers(utterances: DataFrame, names: DataFrame, speaker: str, file: str, unknown: Column) -> DataFrame:
    """utterances with other speakers: those of ``names`` (speaker, new), and where ``unknown`` holds one speaker a file, ``<file>_unknown``. Others stay."""
    renamed = utterances.join(names.select(F.col("speaker").alias(speaker), "new"), speaker, "left")
    own = F.concat(F.col(file).cast("string"), F.lit("_unknown"))
    made = F.when(F.coalesce(unknown, F.lit(False)), own).otherwise(F.coalesce("new", speaker))
    return renamed.withColumn(speaker, made).select(*utterances.columns)
