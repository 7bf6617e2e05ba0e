"""Text and corpus queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import fold_case, graphemes, human_list, is_bracketed, tokens
from ..operators import corpus, sampling
from .base import query, tokens_sql

_T = tokens_sql()
_WORDS = f"SELECT lang, source, doc_id, unnest({_T}) AS word FROM documents"
_VOCABULARY = f"SELECT DISTINCT unnest({_T}) AS word FROM benchmark"


def _text():
    return tokens(F.col("text"))


def _vocabulary(t):
    return t.benchmark.select(F.explode(_text()).alias("word")).distinct()


@query(f"SELECT doc_id, array_to_string({_T}, ' ') AS normalized_text, len({_T}) AS n_words FROM documents")
def normalized_text(t):
    """Transcripts without a dictionary: folded words between breaks."""
    return t.documents.select(
        "doc_id", F.array_join(_text(), " ").alias("normalized_text"), F.size(_text()).cast("long").alias("n_words")
    )


@query(f"SELECT lang, word, count(*) AS n FROM ({_WORDS}) GROUP BY lang, word")
def token_counts(t):
    return corpus.word_counts(t.documents, _text(), "lang")


@query(
    f"SELECT source, count(*) AS n_types, CAST(sum(n) AS BIGINT) AS n_tokens FROM (SELECT source, word, count(*) AS n FROM ({_WORDS}) "
    f"WHERE word NOT IN ({_VOCABULARY}) GROUP BY source, word) GROUP BY source"
)
def oov_types_per_source(t):
    missing = corpus.out_of_vocabulary(corpus.word_counts(t.documents, _text(), "source"), _vocabulary(t))
    return missing.groupBy("source").agg(F.count("*").alias("n_types"), F.sum("n").alias("n_tokens"))


@query(
    f"SELECT lang, word, n, rank FROM (SELECT lang, word, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word) AS rank "
    f"FROM ({_WORDS}) WHERE word NOT IN ({_VOCABULARY}) GROUP BY lang, word) WHERE rank <= 100"
)
def oov_top_words(t):
    """The most frequent unknown words of each dictionary: a top-k report."""
    missing = corpus.out_of_vocabulary(corpus.word_counts(t.documents, _text(), "lang"), _vocabulary(t))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    top = missing.withColumn("rank", rank).where("rank <= 100")
    return top.select("lang", "word", "n", F.col("rank").cast("long").alias("rank"))


@query(
    f"WITH v AS ({_VOCABULARY}), c AS (SELECT word, count(*) AS n FROM ({_WORDS}) GROUP BY word) "
    "SELECT c.word, n, CASE WHEN v.word IS NOT NULL AND n > 2 THEN 'speech' ELSE 'oov' END AS word_type, "
    "v.word IS NOT NULL AND n > 2 AS included FROM c LEFT JOIN v ON c.word = v.word"
)
def oov_threshold(t):
    """Known words that are too rare count as unknown."""
    return corpus.typed_words(corpus.word_counts(t.documents, _text()), _vocabulary(t), 2)


@query(
    f"SELECT doc_id, source, lang FROM documents WHERE source || lang NOT IN (SELECT source || lang FROM documents WHERE len({_T}) < 12)"
)
def ignore_tainted_groups(t):
    """Every utterance of a file is ignored where one of them is too short."""
    docs = t.documents.withColumn("grp", F.concat("source", "lang"))
    short = docs.where(F.size(_text()) < 12)
    return corpus.without_tainted_groups(docs, short, "grp").select("doc_id", "source", "lang")


@query(
    f"SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE len({tokens_sql('d.text')}) >= 4 "
    "AND (coalesce(l.quality = 1, true) OR coalesce(l.toxic = 1, false)) AND (coalesce(n_chars < 20000, true) OR coalesce(l.toxic = 1, false))"
)
def eligible_utterances(t):
    joined = t.documents.join(t.labels.select("doc_id", "quality", "toxic"), "doc_id", "left")
    manual = F.col("toxic") == 1
    return corpus.eligible(joined, _text(), 4, manual, F.col("quality") == 1, F.col("n_chars") < 20000).select("doc_id")


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)")
def semi_flagged_documents(t):
    return t.documents.join(t.labels.where("quality = 0"), "doc_id", "left_semi").select("doc_id", "source")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def anti_flagged_documents(t):
    return corpus.delete_matching(t.documents, t.labels.where("quality = 0"), ["doc_id"]).select("doc_id", "source")


@query(
    f"SELECT lang AS grp, count(*) AS n_utterances, count(DISTINCT source) AS n_speakers, CAST(sum(len({_T})) AS BIGINT) AS n_words, "
    "CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents GROUP BY lang"
)
def corpus_summary(t):
    return corpus.summary(t.documents, F.col("lang"), _text())


@query(
    "SELECT conv_id, string_agg(role || ': ' || md5(text), ' ' ORDER BY turn) AS transcript, count(*) AS n_turns FROM conversations GROUP BY conv_id"
)
def ordered_listagg(t):
    """Turns of a file as one string in order."""
    rows = t.conversations.withColumn("line", F.concat("role", F.lit(": "), F.md5("text")))
    return rows.groupBy("conv_id").agg(
        F.expr("listagg(line, ' ') WITHIN GROUP (ORDER BY turn)").alias("transcript"), F.count("*").alias("n_turns")
    )


@query(
    "SELECT d.doc_id, coalesce(CASE WHEN l.quality = 0 THEN 'rejected' WHEN l.toxic = 1 THEN 'flagged' END, source) AS source, "
    "coalesce(CASE WHEN l.quality = 0 THEN 0 END, n_chars) AS n_chars FROM documents d LEFT JOIN labels l USING (doc_id)"
)
def bulk_update_merge(t):
    changes = t.labels.select(
        "doc_id",
        F.when(F.col("quality") == 0, "rejected").when(F.col("toxic") == 1, "flagged").alias("source"),
        F.when(F.col("quality") == 0, F.lit(0).cast("long")).alias("n_chars"),
    )
    target = t.documents.select("doc_id", "source", "n_chars")
    return corpus.merge_update(target, changes, "doc_id", ["source", "n_chars"], [F.col("source")])


@query(
    "SELECT doc_id, lang FROM documents WHERE lang = 'en' UNION SELECT doc_id, lang FROM documents WHERE n_chars < 500"
)
def dedup_union(t):
    first = t.documents.where("lang = 'en'").select("doc_id", "lang")
    return corpus.insert_or_ignore(first, t.documents.where("n_chars < 500").select("doc_id", "lang"), ["doc_id", "lang"])


@query(
    f"WITH w AS (SELECT DISTINCT lang, word FROM ({_WORDS})), p AS (SELECT a.lang AS lang_a, b.lang AS lang_b FROM (SELECT DISTINCT lang FROM w) a, "
    "(SELECT DISTINCT lang FROM w) b WHERE a.lang < b.lang) SELECT lang_a, lang_b, "
    "(SELECT count(*) FROM w x JOIN w y ON x.word = y.word WHERE x.lang = lang_a AND y.lang = lang_b) AS n_both, "
    "(SELECT count(*) FROM w x WHERE x.lang = lang_a AND NOT EXISTS (SELECT 1 FROM w y WHERE y.lang = lang_b AND y.word = x.word)) AS n_only_a, "
    "(SELECT count(*) FROM w y WHERE y.lang = lang_b AND NOT EXISTS (SELECT 1 FROM w x WHERE x.lang = lang_a AND x.word = y.word)) AS n_only_b FROM p"
)
def set_ops_words(t):
    """Intersection and differences of the dictionaries' word sets, from one set of languages a word."""
    held = corpus.explode_words(t.documents, _text(), "lang").groupBy("word").agg(F.sort_array(F.collect_set("lang")).alias("langs"))
    patterns = held.groupBy("langs").agg(F.count("*").alias("n"))
    langs = t.documents.select("lang").distinct()
    pairs = langs.select(F.col("lang").alias("lang_a")).join(langs.select(F.col("lang").alias("lang_b")), F.col("lang_a") < F.col("lang_b"))
    a, b = F.expr("array_contains(langs, lang_a)"), F.expr("array_contains(langs, lang_b)")
    return (
        pairs.join(patterns, a | b)
        .groupBy("lang_a", "lang_b")
        .agg(
            F.sum(F.when(a & b, F.col("n")).otherwise(0)).alias("n_both"),
            F.sum(F.when(a & ~b, F.col("n")).otherwise(0)).alias("n_only_a"),
            F.sum(F.when(b & ~a, F.col("n")).otherwise(0)).alias("n_only_b"),
        )
    )


@query(
    f"SELECT lang, g AS grapheme, count(*) AS n FROM (SELECT lang, unnest(string_split(word, '')) AS g FROM (SELECT DISTINCT lang, word FROM ({_WORDS}))) GROUP BY lang, g"
)
def grapheme_inventory(t):
    words = corpus.explode_words(t.documents, _text(), "lang").distinct()
    letters = words.select("lang", F.explode(graphemes(F.col("word"))).alias("grapheme"))
    return letters.groupBy("lang", "grapheme").agg(F.count("*").alias("n"))


@query(
    "SELECT role, CASE count(DISTINCT conv_id) % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'a and b' ELSE 'a, b, and c' END AS listed, "
    "count(*) FILTER (regexp_matches(split_part(text, ' ', 1), '^\\[[^\\]]+\\]$')) AS n_bracketed FROM conversations GROUP BY role"
)
def report_strings(t):
    """Lists in words and bracketed first words."""
    counted = t.conversations.groupBy("role").agg(
        F.countDistinct("conv_id").alias("n"),
        F.sum(is_bracketed(F.split("text", " ")[0]).cast("long")).alias("n_bracketed"),
    )
    items = F.when(F.col("n") % 3 == 0, F.array(F.lit("a"))).when(F.col("n") % 3 == 1, F.array(F.lit("a"), F.lit("b")))
    items = items.otherwise(F.array(F.lit("a"), F.lit("b"), F.lit("c")))
    return counted.select("role", human_list(items).alias("listed"), "n_bracketed")


@query(
    "WITH r AS (SELECT doc_id, lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY coalesce(quality, 0) DESC, n_chars, doc_id) AS rank "
    "FROM documents LEFT JOIN labels USING (doc_id)) SELECT doc_id, lang, rank FROM r WHERE rank <= 50"
)
def subset_shortest(t):
    """Training subset: by hand first, then the shortest, a quota for each dictionary."""
    rows = t.documents.join(t.labels, "doc_id", "left").withColumn("quality", F.coalesce("quality", F.lit(0)))
    order = [F.desc("quality"), F.col("n_chars"), F.col("doc_id")]
    first = sampling.first_of_each(rows, ["lang"], order, 50)
    return first.select("doc_id", "lang", F.col("rank").cast("long").alias("rank"))


@query(
    "WITH RECURSIVE c AS (SELECT lang, n, row_number() OVER (ORDER BY n, lang) AS i, count(*) OVER () AS m FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)), "
    "a AS (SELECT i, lang, least(n, 400 // m) AS quota, 400 - least(n, 400 // m) AS left_over FROM c WHERE i = 1 UNION ALL "
    "SELECT c.i, c.lang, least(c.n, a.left_over // (c.m - c.i + 1)), a.left_over - least(c.n, a.left_over // (c.m - c.i + 1)) FROM a JOIN c ON c.i = a.i + 1) "
    "SELECT lang, CAST(quota AS BIGINT) AS quota FROM a"
)
def quota_allocation(t):
    counts = t.documents.groupBy("lang").agg(F.count("*").alias("n"))
    return sampling.allocate_quota(counts, "lang", 400)


@query(
    "WITH RECURSIVE c AS (SELECT source, n, row_number() OVER (ORDER BY n DESC, encode(source)) AS i FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)), "
    "a AS (SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS VARCHAR) AS source, CAST(0 AS BIGINT) AS n, 0 AS job, CAST([0, 0, 0, 0] AS BIGINT[]) AS loads UNION ALL "
    "SELECT c.i, c.source, c.n, CAST(list_position(loads, list_min(loads)) - 1 AS INTEGER), list_transform(loads, lambda x, k: CASE WHEN k = list_position(loads, list_min(loads)) THEN x + c.n ELSE x END) FROM a JOIN c ON c.i = a.i + 1) "
    "SELECT source, n, job FROM a WHERE i > 0"
)
def balanced_jobs(t):
    """Sources dealt to 4 jobs, the largest first to the least loaded."""
    counts = t.documents.groupBy("source").agg(F.count("*").alias("n"))
    return sampling.balance(counts, "source", 4)


@query(
    "WITH s AS (SELECT source, count(*) AS n FROM documents WHERE n_chars <= (SELECT avg(n_chars) FROM documents) GROUP BY source), "
    "k AS (SELECT CASE WHEN sum(n) FILTER (n >= 30) >= 300 THEN 30 WHEN sum(n) FILTER (n >= 15) >= 300 THEN 15 ELSE 5 END AS least FROM s) "
    "SELECT source, n FROM s, k WHERE n >= least"
)
def speaker_ladder(t):
    """Speakers with enough utterances no longer than the mean."""
    return sampling.speaker_ladder(t.documents, "source", "n_chars", 300)


@query("SELECT word, letters FROM (SELECT DISTINCT word, len(word) AS letters FROM (" + _WORDS + ")) WHERE letters > 12")
def long_words(t):
    words = corpus.explode_words(t.documents, _text()).distinct()
    return words.select("word", F.length(fold_case(F.col("word"))).cast("long").alias("letters")).where("letters > 12")


_LETTERS = f"SELECT DISTINCT unnest(string_split(word, '')) AS grapheme FROM (SELECT DISTINCT word FROM ({_WORDS}))"


@query(f"SELECT grapheme, row_number() OVER (ORDER BY encode(grapheme)) - 1 AS id FROM ({_LETTERS})")
def symbol_table(t):
    """Graphemes with dense ids in code-point order."""
    letters = corpus.explode_words(t.documents, _text()).distinct().select(F.explode(graphemes(F.col("word"))).alias("grapheme"))
    return corpus.dense_ids(letters.distinct(), "grapheme")


@query(
    "SELECT doc_id, CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) * 7 / count(*) OVER ()) AS BIGINT) AS job FROM documents"
)
def contiguous_jobs(t):
    """Utterances dealt to 7 jobs in ranges of ids."""
    return corpus.job_ranges(corpus.dense_ids(t.documents.select("doc_id"), "doc_id"), 7).select("doc_id", "job")


@query(
    f"WITH c AS (SELECT word, count(*) AS n FROM ({_WORDS}) GROUP BY word) SELECT word, n, word IN (SELECT word FROM ({_WORDS}) WHERE lang = 'en') AS included FROM c"
)
def lexicon_subset(t):
    english = corpus.explode_words(t.documents.where("lang = 'en'"), _text())
    return corpus.in_subset(corpus.word_counts(t.documents, _text()), english)


@query(
    f"SELECT word, round(avg(n), 6) AS mean_count, count(*) AS n_dictionaries FROM (SELECT lang, word, count(*) AS n FROM ({_WORDS}) GROUP BY ALL) GROUP BY word"
)
def merged_dictionary(t):
    """One dictionary from all, values averaged."""
    counts = corpus.word_counts(t.documents, _text(), "lang")
    return counts.groupBy("word").agg(F.round(F.avg("n"), 6).alias("mean_count"), F.count("*").alias("n_dictionaries"))
