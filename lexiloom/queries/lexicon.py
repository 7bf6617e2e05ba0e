"""Queries on derived lexicons, table edits and further models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators import corpus, g2p, intervals, lexicon, vectors
from ..operators import language_model as lm
from .base import one_byte_sql, query, tokens_sql
from .intervals import _SPANS, _spans

_T = tokens_sql()
_LEXICON = f"SELECT DISTINCT word, array_to_string(list_filter(string_split(word, ''), lambda x: x <> ''), ' ') AS pronunciation FROM (SELECT unnest({_T}) AS word FROM benchmark)"
_COUNTS = f"SELECT word, count(*) AS n FROM (SELECT unnest({_T}) AS word FROM documents) GROUP BY word"


def _text():
    return tokens(F.col("text"))


def _lexicon(t):
    words = t.benchmark.select(F.explode(_text()).alias("word")).distinct()
    letters = F.filter(F.split("word", ""), lambda x: x != "")
    return words.select("word", letters.alias("phones"), F.array_join(letters, " ").alias("pronunciation"))


@query(
    f"WITH l AS (SELECT word, string_split(pronunciation, ' ') AS p FROM ({_LEXICON})), c AS ({_COUNTS}), e AS (SELECT l.word, p, coalesce(n > 1, false) AS included FROM l LEFT JOIN c ON l.word = c.word) "
    "SELECT DISTINCT '<cutoff-' || word || '>' AS word, 'spn' AS pronunciation, 0.01::DOUBLE AS probability, included FROM e UNION SELECT DISTINCT '<cutoff-' || word || '>', array_to_string(p[1:k], ' '), 0.99::DOUBLE, included FROM (SELECT *, unnest(range(1, len(p) + 1)) AS k FROM e)"
)
def cutoff_entries(t):
    return lexicon.cutoff_entries(_lexicon(t), corpus.word_counts(t.documents, _text()))


@query(
    f"SELECT word, min(lang) AS lang, arg_min(n, lang) AS n FROM (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest({_T}) AS word FROM documents) GROUP BY ALL) GROUP BY word"
)
def nonnative_dictionary(t):
    """Words of all dictionaries, the first dictionary's entry each."""
    return lexicon.first_pronunciations(corpus.word_counts(t.documents, _text(), "lang"), "lang").select("word", "lang", "n")


_RULES = [("t h", "", "", "θ"), ("e", "", "$", ""), ("s", "^", "", "z"), ("n", "", "d", "m")]


@query(
    f"WITH l AS (SELECT word, pronunciation, ' ' || pronunciation || ' ' AS p FROM ({_LEXICON})) SELECT word, 0 AS rule FROM l WHERE p LIKE '% t h %' UNION ALL SELECT word, 1 FROM l WHERE p LIKE '% e ' "
    "UNION ALL SELECT word, 2 FROM l WHERE p LIKE ' s %' UNION ALL SELECT word, 3 FROM l WHERE p LIKE '% n d %'"
)
def rule_matches(t):
    return lexicon.matching_rules(_lexicon(t).select("word", "pronunciation"), _RULES).select("word", "rule")


_ENDS = f"SELECT DISTINCT word FROM ({_COUNTS})"


@query(
    f"WITH l AS (SELECT word, pronunciation, ' ' || pronunciation || ' ' AS p FROM ({_LEXICON})), m AS (SELECT word, 1 AS rule, left(word, length(word) - 1) AS made FROM l WHERE p LIKE '% e ' "
    "UNION ALL SELECT word, 2, 'z' || substr(word, 2) FROM l WHERE p LIKE ' s %' UNION ALL SELECT word, 3, replace(word, 'nd', 'md') FROM l WHERE p LIKE '% n d %' UNION ALL SELECT word, 0, replace(word, 'th', 'θ') FROM l WHERE p LIKE '% t h %') "
    f"SELECT rule, count(*) AS n_matched, count(*) FILTER (made IN ({_ENDS})) AS n_used FROM m GROUP BY rule"
)
def rule_statistics(t):
    """Rules by how often what they make is in use: here, whether the corpus has a word of that spelling."""
    base = _lexicon(t).select("word", "pronunciation")
    matched = lexicon.matching_rules(base, _RULES)
    spoken = corpus.word_counts(t.documents, _text()).select(F.col("word").alias("_s"))
    spelled = matched.withColumn("_s", F.replace("applied", F.lit(" "), F.lit("")))
    used = spelled.join(spoken, "_s", "left_semi").select("word", F.col("applied").alias("pronunciation"))
    return lexicon.rule_statistics(matched, used).select("rule", "n_matched", "n_used")


@query(
    f"WITH w AS (SELECT word, list_filter(string_split(word, ''), lambda x: x <> '') AS g, substr(md5(word), 1, 1) IN ('0', '1') AS picked FROM ({_COUNTS})), k AS (SELECT DISTINCT unnest(g) AS l FROM w WHERE NOT picked) "
    "SELECT word, picked AND NOT EXISTS (SELECT 1 FROM unnest(g) u(l) WHERE l NOT IN (SELECT l FROM k)) AS held_out FROM w"
)
def hold_out_repair(t):
    """Held-out words, less those with a letter that the training words lack."""
    words = corpus.word_counts(t.documents, _text()).select("word")
    letters = F.filter(F.split("word", ""), lambda x: x != "")
    return lexicon.hold_out(words, letters, F.substring(F.md5("word"), 1, 1).isin("0", "1"))


@query(
    f"WITH w AS (SELECT lang, list_concat(['<s>'], {_T}, ['</s>']) AS a FROM documents), p AS (SELECT lang, x[1] AS history, x[2] AS word, count(*) AS n FROM (SELECT lang, unnest(list_zip(a, a[2:])) AS x FROM w) WHERE x[2] IS NOT NULL GROUP BY ALL) "
    "SELECT lang, history, word, n, round((n - 0.75) / sum(n) OVER h + 0.75 * count(*) OVER h / sum(n) OVER h * count(*) OVER (PARTITION BY lang, word) / count(*) OVER (PARTITION BY lang), 8) AS p FROM p WINDOW h AS (PARTITION BY lang, history)"
)
def kneser_ney_bigrams(t):
    return lm.kneser_ney(t.documents, _text(), "lang").select("lang", "history", "word", "n", F.round("p", 8).alias("p"))


@query(
    f"SELECT conv_id, turn, i - 1 AS word_index, j - 1 AS phone_index, w[i][j] AS phone FROM (SELECT conv_id, turn, w, i, unnest(range(1, len(w[i]) + 1)) AS j FROM (SELECT conv_id, turn, {_T} AS w, unnest(range(1, len({_T}) + 1)) AS i FROM conversations))"
)
def collect_alignments(t):
    """Two levels of nested intervals as rows."""
    letters = lambda w: F.filter(F.split(w, ""), lambda x: x != "")
    nested = F.transform(_text(), lambda w: F.struct(w.alias("word"), letters(w).alias("phones")))
    _, phones = lexicon.collect_alignments(t.conversations.withColumn("nested", nested), "nested", "conv_id", "turn")
    return phones.select("conv_id", "turn", F.col("word_index").cast("long").alias("word_index"), F.col("phone_index").cast("long").alias("phone_index"), "phone")


@query(
    f"SELECT conv_id, turn, array_to_string(list_filter({_T}, lambda x: x NOT IN ('the', 'of', 'a')), ' ') AS text FROM conversations"
)
def rebuilt_transcripts(t):
    """Transcripts from word rows in order, pauses left out."""
    rows = t.conversations.select("conv_id", "turn", F.posexplode_outer(_text()).alias("i", "word"))
    word = F.when(~F.col("word").isin("the", "of", "a"), F.struct("i", "word"))
    listed = rows.groupBy("conv_id", "turn").agg(F.sort_array(F.collect_list(word)).alias("w"))
    return listed.select("conv_id", "turn", F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("text"))


@query(
    "SELECT doc_id, k - 1 AS segment, string_split(text, chr(10))[k] AS text FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS k FROM documents)"
)
def split_utterances(t):
    """Utterances replaced by their segments (here: lines)."""
    rows = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("segment", "text"))
    return rows.select("doc_id", F.col("segment").cast("long").alias("segment"), "text")


@query(
    "WITH l AS (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, source, l, unnest(range(1, len(l) + 1)) AS k FROM l WHERE len(l) > 1) "
    "SELECT doc_id, source, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM s) UNION ALL "
    "SELECT (SELECT max(doc_id) FROM documents) + row_number() OVER (ORDER BY doc_id, k), source, l[k] FROM s"
)
def segmented_utterances(t):
    """Utterances of several segments (here: lines) replaced by these, with new ids."""
    rows = t.documents.select("doc_id", "source", "text")
    lines = rows.where(F.size(F.split("text", "\n")) > 1).select("doc_id", F.posexplode(F.split("text", "\n")).alias("segment", "text"))
    return corpus.replace_by_segments(rows, lines, "doc_id", "segment")


@query(
    "SELECT doc_id, CASE WHEN n_chars < 300 THEN doc_id || '_unknown' ELSE coalesce(m.new, source) END AS speaker FROM documents LEFT JOIN (SELECT DISTINCT source, min(source) OVER (PARTITION BY length(source)) AS new FROM documents) m USING (source)"
)
def merged_speakers(t):
    """Speakers renamed by a mapping; unknown ones (here: of short texts) become one speaker a file."""
    names = t.documents.groupBy("source").agg(F.count("*").alias("n"))
    first = names.groupBy(F.length("source").alias("l")).agg(F.min("source").alias("new"))
    mapping = names.join(first, F.length("source") == F.col("l")).select(F.col("source").alias("speaker"), "new")
    rows = t.documents.select("doc_id", F.col("source").alias("speaker"), "n_chars")
    return corpus.rename_speakers(rows, mapping, "speaker", "doc_id", F.col("n_chars") < 300).select("doc_id", "speaker")


@query(
    f"WITH w AS (SELECT conv_id, turn, word_index, word, row_number() OVER (ORDER BY conv_id, turn, word_index) - 1 AS id FROM (SELECT conv_id, turn, a[i] AS word, i - 1 AS word_index FROM (SELECT conv_id, turn, {_T} AS a, unnest(range(1, len({_T}) + 1)) AS i FROM conversations))), "
    f"v AS (SELECT word, row_number() OVER (ORDER BY encode(word)) - 1 AS word_id FROM (SELECT DISTINCT unnest({_T}) AS word FROM benchmark)), "
    "n AS (SELECT word, (SELECT max(word_id) FROM v) + row_number() OVER (ORDER BY encode(word)) AS word_id FROM (SELECT DISTINCT word FROM w WHERE word NOT IN (SELECT word FROM v))), "
    "x AS (SELECT * FROM v UNION ALL SELECT * FROM n), p AS (SELECT w.id AS owner, word_id, string_split(word, '') AS l FROM w JOIN x USING (word)), "
    "q AS (SELECT owner, word_id, j, l[j] AS phone FROM (SELECT owner, word_id, l, unnest(range(1, len(l) + 1)) AS j FROM p)) "
    "SELECT row_number() OVER (ORDER BY owner, j) - 1 AS id, owner AS word_interval_id, word_id, j - 1 AS phone_index, phone FROM q"
)
def numbered_alignments(t):
    """Phone intervals with ids, those of their word intervals and of their words, new words included."""
    letters = lambda w: F.filter(F.split(w, ""), lambda x: x != "")
    nested = F.transform(_text(), lambda w: F.struct(w.alias("word"), letters(w).alias("phones")))
    known = corpus.dense_ids(t.benchmark.select(F.explode(_text()).alias("word")).distinct(), "word", name="word_id")
    _, phones, _ = lexicon.numbered_alignments(t.conversations, nested, known, "conv_id", "turn")
    return phones.select("id", "word_interval_id", "word_id", F.col("phone_index").cast("long").alias("phone_index"), "phone")


@query(
    f"SELECT event_id, j AS piece, begin + CAST(floor((\"end\" - begin) * j / n) AS BIGINT) AS begin, begin + CAST(floor((\"end\" - begin) * (j + 1) / n) AS BIGINT) AS \"end\", ls[j + 1] AS label FROM "
    f"(SELECT *, len(ls) AS n, CAST(unnest(range(len(ls))) AS INTEGER) AS j FROM (SELECT *, CASE label WHEN 'view' THEN ['v', 'ie', 'w'] WHEN 'click' THEN ['cl', 'ick'] ELSE [label] END AS ls FROM ({_SPANS})))"
)
def remapped_intervals(t):
    rows = _spans(t).select("event_id", "begin", "end", "label")
    made = intervals.split_labels(rows, {"view": ["v", "ie", "w"], "click": ["cl", "ick"]})
    return made.select("event_id", "piece", "begin", "end", "label")


_SEQUENCES = {"view click": ["vc"], "view click view": ["v", "cv"], "click view": ["cv"], "error": ["er", "ror"], "purchase": ["p", "ur", "chase"], "signup signup": ["two"]}
#: Length of the longest entry that begins at place i of the list ls.
_LENGTH_SQL = (
    "CASE WHEN ls[i:i + 2] = ['view', 'click', 'view'] THEN 3 WHEN ls[i:i + 1] IN (['view', 'click'], ['click', 'view'], ['signup', 'signup']) THEN 2 ELSE 1 END"
)


@query(
    f"WITH RECURSIVE s AS (SELECT user_id, list(label ORDER BY begin, event_id) AS ls, list(begin ORDER BY begin, event_id) AS bs, list(\"end\" ORDER BY begin, event_id) AS es, list(event_id ORDER BY begin, event_id) AS ids FROM ({_SPANS}) GROUP BY user_id), "
    f"r AS (SELECT user_id, 1 AS i FROM s UNION ALL SELECT user_id, i + n FROM (SELECT user_id, i, {_LENGTH_SQL} AS n, len(ls) AS size FROM r JOIN s USING (user_id)) WHERE i + n <= size), "
    f"m AS (SELECT user_id, ids[i] AS event_id, bs[i] AS b, es[i + {_LENGTH_SQL} - 1] AS e, CASE array_to_string(ls[i:i + {_LENGTH_SQL} - 1], ' ') "
    + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in _SEQUENCES.items())
    + " ELSE [ls[i]] END AS made FROM r JOIN s USING (user_id)), "
    "p AS (SELECT *, len(made) AS n, CAST(unnest(range(len(made))) AS INTEGER) AS piece FROM m) "
    "SELECT user_id, event_id, piece, made[piece + 1] AS label, CASE WHEN n = 2 AND piece = 1 THEN b + CAST(floor((e - b) * 0.75::DOUBLE) AS BIGINT) ELSE b + CAST(floor((e - b) * piece / n) AS BIGINT) END AS begin, "
    "CASE WHEN n = 2 AND piece = 0 THEN b + CAST(floor((e - b) * 0.75::DOUBLE) AS BIGINT) ELSE b + CAST(floor((e - b) * (piece + 1) / n) AS BIGINT) END AS \"end\" FROM p"
)
def remapped_sequences(t):
    """Labels of each user's intervals remapped by the longest sequence from the left, with splits at three quarters."""
    rows = _spans(t).select("user_id", "event_id", "begin", "end", "label")
    return intervals.remap_labels(rows, ["user_id"], ["begin", "event_id"], _SEQUENCES, 0.75)


@query(
    f"SELECT user_id, label, min(begin) AS begin, max(\"end\") AS \"end\", count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY begin, event_id) AS run FROM (SELECT *, CASE WHEN label IS NOT DISTINCT FROM lag(label) OVER "
    f"(PARTITION BY user_id ORDER BY begin, event_id) THEN 0 ELSE 1 END AS fresh FROM ({_SPANS}))) GROUP BY user_id, run, label"
)
def merged_label_runs(t):
    return intervals.merge_equal_labels(_spans(t), ["user_id"], ["begin", "event_id"])


@query(
    f"WITH w AS (SELECT word, replace(word, 'th', 'z') AS h1, regexp_replace(word, 'e$', '') AS h2 FROM ({_COUNTS})), "
    f"s AS (SELECT least(levenshtein({one_byte_sql('word')}, {one_byte_sql('h1')}), levenshtein({one_byte_sql('word')}, {one_byte_sql('h2')})) AS e, length(word) AS n FROM w) "
    "SELECT count(*) AS n_words, round(count(*) FILTER (e > 0) / count(*), 9) AS wer, round(sum(e) / sum(n), 9) AS ler FROM s"
)
def g2p_letter_errors(t):
    """Word and letter error rates of two generated pronunciations a word against the given one (letters as phones)."""
    words = corpus.word_counts(t.documents, _text())
    spaced = lambda w: F.array_join(F.filter(F.split(w, ""), lambda x: x != ""), " ")
    made = F.array(spaced(F.replace("word", F.lit("th"), F.lit("z"))), spaced(F.regexp_replace("word", "e$", "")))
    out = g2p.evaluation(words.select("word", made.alias("hypotheses"), F.array(spaced(F.col("word"))).alias("gold")))
    return out.select("n_words", F.round("wer", 9).alias("wer"), F.round("ler", 9).alias("ler"))


@query(
    f"WITH l AS (SELECT word, list_filter(string_split(word, ''), lambda x: x <> '') AS a FROM (SELECT DISTINCT word FROM ({_COUNTS}))), g AS (SELECT unnest(a) AS ngram FROM l UNION ALL SELECT x[1] || ' ' || x[2] FROM (SELECT unnest(list_zip(a, a[2:])) AS x FROM l) WHERE x[2] IS NOT NULL) "
    "SELECT side, ngram, count(*) AS n FROM g, (SELECT unnest(['letters', 'phones']) AS side) GROUP BY ALL"
)
def valid_chunks(t):
    """N-grams of letters and phones (here: letters too) from which chunks are made."""
    letters = F.filter(F.split("word", ""), lambda x: x != "")
    return g2p.valid_chunks(corpus.word_counts(t.documents, _text()).select(letters.alias("letters"), letters.alias("phones")))


@query(
    f"WITH l AS (SELECT word, min(pronunciation) AS p FROM ({_LEXICON}) GROUP BY word), w AS (SELECT conv_id, turn, {_T} AS a FROM conversations), x AS (SELECT conv_id, turn, unnest(a) AS word, generate_subscripts(a, 1) AS i FROM w) "
    "SELECT w.conv_id, w.turn, coalesce(s, '') AS pronunciation FROM w LEFT JOIN (SELECT conv_id, turn, string_agg(coalesce(p, 'spn'), ' ' ORDER BY i) AS s FROM x LEFT JOIN l ON x.word = l.word GROUP BY ALL) USING (conv_id, turn)"
)
def utterance_pronunciations(t):
    """Each turn as the pronunciations of its words."""
    return g2p.spoken(t.conversations, ["conv_id", "turn"], _text(), _lexicon(t).select("word", "pronunciation"))


@query()
def discriminant_vectors(t):
    """Embeddings on the axes that separate speakers best."""
    matrix = vectors.discriminant_projection(t.embeddings, "embedding", "label", 4)
    return vectors.project(t.embeddings, "embedding", matrix).select("vec_id", "label", "projected")


@query()
def iterative_speaker_clusters(t):
    return vectors.iterative_clusters(t.embeddings, "embedding", "vec_id", "label")


def _aligned_lexicon(t):
    made = lexicon.apply_rule(F.col("pronunciation"), "t h", "", "", "θ")
    return _lexicon(t).select("word", F.col("phones").alias("letters"), F.split(made, " ").alias("phones"))


@query()
def m2m_alignment(t):
    """Chunk weights of a many-to-many alignment between spellings and pronunciations."""
    return g2p.train_alignment(_aligned_lexicon(t), rounds=4, most=(2, 1))


@query()
def g2p_generation(t):
    """Pronunciations of the lexicon's own words, three at most a word."""
    weights = g2p.train_alignment(_aligned_lexicon(t), rounds=4, most=(2, 1))
    return g2p.generate(_aligned_lexicon(t), F.col("letters"), weights)
