"""Command-level programs: one call for each task a user of a speech toolkit knows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators import corpus, dictionary, g2p, intervals, language_model, lexicon, metrics, selection, vectors
from ..sinks import files as sinks


def find_oovs(utterances: DataFrame, words: DataFrame, group: str = "dictionary") -> DataFrame:
    """group, word, n of words (utterances: group, text) that the word list lacks."""
    return corpus.out_of_vocabulary(corpus.word_counts(utterances, tokens(F.col("text")), group), words)


def normalize_text(utterances: DataFrame) -> DataFrame:
    return utterances.withColumn("normalized_text", F.array_join(tokens(F.col("text")), " "))


def validate_corpus(utterances: DataFrame, words: DataFrame) -> DataFrame:
    """One row: utterances, speakers, words, empty texts and words out of vocabulary."""
    rows = utterances.withColumn("_w", tokens(F.col("text")))
    totals = rows.agg(
        F.count("*").alias("n_utterances"),
        F.countDistinct("speaker").alias("n_speakers"),
        F.sum(F.size("_w")).alias("n_words"),
        F.sum((F.size("_w") == 0).cast("long")).alias("n_empty"),
    )
    missing = corpus.out_of_vocabulary(corpus.word_counts(rows, F.col("_w")), words)
    oov = missing.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_oov"), F.count("*").alias("n_oov_types"))
    return totals.crossJoin(oov)  # one row each


def analyze_alignments(rows: DataFrame) -> DataFrame:
    """utterance, n, worst: the largest deviation of log durations (utterance, label, duration)."""
    z = intervals.zscores(rows, "label", F.col("duration"))
    return z.groupBy("utterance").agg(F.count("*").alias("n"), F.max(F.abs("z")).alias("worst"))


def evaluate_alignments(reference: DataFrame, hypothesis: DataFrame, key: str = "utterance") -> DataFrame:
    return metrics.evaluate_alignments(reference, hypothesis, key)


def evaluate_transcriptions(rows: DataFrame) -> DataFrame:
    """ser, wer, cer with severity (rows: gold, hyp texts)."""
    words = rows.withColumns({"_g": tokens(F.col("gold")), "_h": tokens(F.col("hyp"))})
    return metrics.error_report(metrics.error_counts(words, "_g", "_h"))


def segment(frames: DataFrame, on: float, off: float, pause: int, longest: int) -> DataFrame:
    """key, begin, end, n: active stretches of frames (key, at, value) merged into segments."""
    active = intervals.hysteresis(frames, ["key"], ["at"], F.col("value"), on, off)
    rows = active.select("key", F.col("first").alias("begin"), F.col("last").alias("end"))
    return intervals.merge_segments(rows, ["key"], pause, longest)


def diarize(rows: DataFrame, threshold: float | None = None) -> DataFrame:
    """rows (embedding, speaker) classified to the nearest speaker centroid, unknown below the threshold."""
    return vectors.nearest_centroid(rows, "embedding", vectors.centroids(rows, "embedding", "speaker"), "speaker", threshold)


def train_lm(utterances: DataFrame, group: str) -> tuple[DataFrame, DataFrame]:
    return language_model.bigram_model(utterances, tokens(F.col("text")), group)


def train_dictionary(rows: DataFrame, silence: tuple[str, ...]) -> DataFrame:
    """word, probabilities from word intervals in order (utterance, begin, word)."""
    counts = lexicon.pronunciation_counts(rows, ["utterance"], "begin", F.col("word").isin(*silence))
    return lexicon.pronunciation_probabilities(counts.withColumn("entry", F.col("word")), "entry")


def train_dictionary_with_corrections(rows: DataFrame, silence: tuple[str, ...]) -> DataFrame:
    """word, probability, silence_after and both corrections of the silence before: all that a lexicon's fields hold."""
    counts = lexicon.pronunciation_counts(rows, ["utterance"], "begin", F.col("word").isin(*silence))
    known = lexicon.pronunciation_probabilities(counts.withColumn("entry", F.col("word")), "entry")
    pairs = lexicon.pronunciation_pairs(rows, ["utterance"], "begin", F.col("word").isin(*silence))
    before = lexicon.before_corrections(counts, pairs.groupBy("previous", "word").agg(F.sum("n").alias("n")), known)
    return known.select("word", "probability", "silence_after").join(before, "word")


def train_g2p(entries: DataFrame, rounds: int = 6, most: tuple[int, int] = (2, 2)) -> DataFrame:
    """Chunk weights from a dictionary (word, phones)."""
    letters = F.filter(F.split("word", ""), lambda x: x != "")
    return g2p.train_alignment(entries.select("word", letters.alias("letters"), "phones"), rounds, most)


def generate_pronunciations(words: DataFrame, weights: DataFrame, best: int = 3, strict: bool = True) -> DataFrame:
    """word, rank, pronunciation, score; strict leaves out words with letters that the model doesn't know."""
    letters = F.filter(F.split("word", ""), lambda x: x != "")
    if strict:
        known = weights.where(F.col("letters") != g2p.EMPTY).select(F.explode(F.split("letters", " ")).alias("l"))
        known = known.agg(F.sort_array(F.collect_set("l")).alias("_known"))  # an alphabet
        words = g2p.strict_words(words.crossJoin(F.broadcast(known)), F.col("_known")).drop("_known")
    return g2p.generate(words, letters, weights, best)


def validate_dictionary(entries: DataFrame, weights: DataFrame) -> DataFrame:
    """word, pronunciation, generated, edits: entries beside what a model makes of their spelling, the worst first."""
    made = generate_pronunciations(entries.select("word").distinct(), weights, 1, strict=False)
    given = entries.select("word", F.array_join("phones", " ").alias("pronunciation"))
    return dictionary.validated(given, made).orderBy(F.desc("edits"), "word", "pronunciation")


def remap_dictionary(entries: DataFrame, mapping: dict[str, list[str]], phones: tuple[str, ...] | None = None) -> DataFrame:
    """Entries with other phones, those with unknown phones left out (see lexicon.remap_alternatives)."""
    return lexicon.remap_alternatives(entries, mapping, phones)


def remap_alignments(rows: DataFrame, mapping: dict[str, list[str]], key: str = "utterance", share: float = 0.5) -> DataFrame:
    """Intervals with other labels: one label or several in a row become one or several (see intervals.remap_labels)."""
    return intervals.remap_labels(rows, [key], ["begin", "end"], mapping, share)


def compare_alignments(reference: DataFrame, hypothesis: DataFrame, key: str = "utterance") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(totals, each utterance, confusions with examples) of two sets of aligned intervals."""
    pairs = metrics.aligned_pairs(reference, hypothesis, key)
    return metrics.alignment_totals(pairs), metrics.evaluate_alignments(reference, hypothesis, key), metrics.confusion_examples(pairs, key)


def cluster_speakers(rows: DataFrame, vector: str = "embedding", method: str = "kmeans", truth: str | None = None, **options) -> tuple[DataFrame, DataFrame | None]:
    """(rows with cluster, scores against the true speakers if they are known)."""
    made = vectors.cluster(rows, vector, method, **options)
    if truth is None:
        return made, None
    return made, vectors.cluster_scores(vectors.contingency(made, "cluster", truth), "cluster", truth)


def validation_report(files: DataFrame, utterances: DataFrame, words: DataFrame, readable: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(summary, words out of vocabulary by dictionary, files with a problem) of a corpus; utterances: dictionary, speaker, text."""
    missing = find_oovs(utterances, words)
    return validate_corpus(utterances, words), sinks.oov_report(missing), sinks.error_lists(files, readable)


def corpus_hours(utterances: DataFrame, path: str) -> DataFrame:
    """part, n_utterances, n_files, n_speakers, hours of each first folder of the path (utterances: begin, end in seconds, speaker)."""
    part = F.get(F.split(F.ltrim(F.col(path), F.lit("/")), "/"), 0)
    return utterances.groupBy(part.alias("part")).agg(
        F.count("*").alias("n_utterances"), F.countDistinct(path).alias("n_files"), F.countDistinct("speaker").alias("n_speakers"),
        (F.sum(F.col("end") - F.col("begin")) / 3600).alias("hours"),
    )


def training_stages(utterances: DataFrame, **columns) -> list[tuple[int, DataFrame]]:
    """(size, utterances) of each stage of a training curriculum; columns as selection.training_subset names them."""
    total = utterances.count()
    return [(n, utterances if n >= total else selection.training_subset(utterances, n, **columns)) for n in selection.stage_sizes(total)]
