"""Dictionary queries: benchmark words as the lexicon, languages as dictionaries, letters as phones."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.phones import ARPA, IPA_ONLY, PINYIN, phone_set_votes
from ..functions.text import nested_text, tokens
from ..operators import corpus, dictionary
from .base import query, tokens_sql

_T = tokens_sql()
_WORDS = f"SELECT DISTINCT unnest({_T}) AS word FROM benchmark"
_LETTERS = "list_filter(string_split(word, ''), lambda x: x <> '')"
_COUNTS = f"SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest({_T}) AS word FROM documents) GROUP BY ALL"


def _text():
    return tokens(F.col("text"))


def _lexicon(t):
    words = t.benchmark.select(F.explode(_text()).alias("word")).distinct()
    return words.select("word", F.filter(F.split("word", ""), lambda x: x != "").alias("phones"))


_CLASSES = " UNION ALL ".join(
    [f"SELECT phone, '{k}' AS class FROM p WHERE phone[1] IN ({', '.join(repr(x) for x in v.split())})" for k, v in dictionary.PHONE_CLASSES.items()]
    + [f"SELECT phone, '{k}' FROM p WHERE contains(phone, '{v}')" for k, v in dictionary.DIACRITIC_CLASSES.items()]
)


@query(f"WITH p AS (SELECT DISTINCT unnest({_LETTERS}) AS phone FROM ({_WORDS})) {_CLASSES}")
def phone_class_lookup(t):
    """Classes of the phones (here: letters) of a lexicon."""
    return dictionary.phone_classes(_lexicon(t).select(F.explode("phones").alias("phone")).distinct())


@query(
    f"SELECT phone, type, row_number() OVER (ORDER BY part, k, encode(phone)) - 1 AS id FROM (SELECT * FROM (VALUES (0, 0, '<eps>', 'extra'), (0, 1, 'sil', 'silence'), (0, 2, 'spn', 'oov'), "
    f"(2, 0, '#0', 'disambiguation'), (2, 1, '#1', 'disambiguation'), (2, 2, '#2', 'disambiguation')) v(part, k, phone, type) UNION ALL SELECT 1, 0, phone, 'non_silence' FROM (SELECT DISTINCT unnest({_LETTERS}) AS phone FROM ({_WORDS})))"
)
def phone_table(t):
    return dictionary.phone_table(_lexicon(t))


@query(f"SELECT word_type, count(*) AS n FROM (SELECT 'speech' AS word_type FROM ({_WORDS}) UNION ALL SELECT unnest(['silence', 'oov', 'bracketed', 'cutoff', 'laughter'])) GROUP BY ALL")
def special_words(t):
    return dictionary.with_special_words(_lexicon(t)).groupBy("word_type").agg(F.count("*").alias("n"))


@query(f"SELECT word FROM ({_WORDS}) WHERE len(list_filter({_LETTERS}, lambda x: x NOT IN ('a', 'b', 'd', 'e', 'h', 'i', 'n', 'o', 'r', 's', 't', 'l', 'u'))) = 0")
def inventory_filter(t):
    """Entries whose phones are all in an inventory."""
    return dictionary.load(_lexicon(t), list("abdehinorstlu")).select("word")


@query(f"WITH c AS ({_COUNTS}) SELECT lang, word, n FROM c WHERE lang = 'en' UNION ALL SELECT lang, word, n FROM c WHERE lang = 'de' AND word NOT IN (SELECT word FROM c WHERE lang = 'en')")
def added_words(t):
    counts = corpus.word_counts(t.documents, _text(), "lang")
    return dictionary.add_words(counts.where("lang = 'en'"), counts.where("lang = 'de'"), ["word"])


@query(f"SELECT DISTINCT c.word, CASE WHEN l.word IS NOT NULL THEN array_to_string(list_filter(string_split(l.word, ''), lambda x: x <> ''), ' ') END AS pronunciation FROM (SELECT DISTINCT word FROM ({_COUNTS})) c LEFT JOIN ({_WORDS}) l ON c.word = l.word")
def word_pronunciations(t):
    lexicon = _lexicon(t).select("word", F.array_join("phones", " ").alias("pronunciation"))
    return dictionary.word_pronunciations(corpus.word_counts(t.documents, _text()), lexicon)


@query(
    f"WITH s AS (SELECT word, row_number() OVER (ORDER BY encode(word)) - 1 AS id FROM ({_WORDS})) SELECT conv_id, turn, c.word, coalesce(id, -1) AS id FROM (SELECT conv_id, turn, unnest({_T}) AS word FROM conversations) c LEFT JOIN s ON c.word = s.word"
)
def word_id_lookup(t):
    table = corpus.dense_ids(_lexicon(t).select("word"), "word")
    rows = t.conversations.select("conv_id", "turn", F.explode(_text()).alias("word"))
    return dictionary.lookup_ids(rows, table, ["word"], -1).select("conv_id", "turn", "word", "id")


@query(f"SELECT '<cutoff-' || b.p || '>' AS cutoff, c.word FROM (SELECT DISTINCT substr(word, 1, 4) AS p FROM ({_WORDS}) WHERE length(word) > 5) b JOIN (SELECT DISTINCT word FROM ({_COUNTS})) c ON starts_with(c.word, b.p)")
def cutoff_completions(t):
    pieces = _lexicon(t).where("length(word) > 5").select(F.concat(F.lit("<cutoff-"), F.substring("word", 1, 4), F.lit(">")).alias("word")).distinct()
    return dictionary.cutoff_completions(pieces, corpus.word_counts(t.documents, _text()).select("word"))


@query(
    f"WITH c AS (SELECT lang, left(word, 2) AS w, word, n FROM ({_COUNTS})), m AS (SELECT *, n >= 0.1 * max(n) OVER (PARTITION BY lang, w) AS keep FROM c) SELECT lang AS dictionary, count(*) AS n_before, count(*) FILTER (keep) AS n_after FROM m GROUP BY lang"
)
def pruned_pronunciations(t):
    """Words with one beginning as pronunciations of it; numbers before and after pruning."""
    counts = corpus.word_counts(t.documents, _text(), "lang")
    rows = counts.select(F.col("lang").alias("dictionary"), F.substring("word", 1, 2).alias("word"), F.col("word").alias("pronunciation"), "n")
    return dictionary.pruned(rows, "n", 0.1)[1]


@query(f"SELECT word, word AS pronunciation, round(avg(n / t), 8) AS probability, round(avg(sqrt(n)), 8) AS silence_after, count(*) AS n_dictionaries FROM (SELECT *, sum(n) OVER (PARTITION BY lang) AS t FROM ({_COUNTS})) GROUP BY word")
def averaged_probabilities(t):
    counts = corpus.word_counts(t.documents, _text(), "lang")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("t"))
    rows = counts.join(totals, "lang").select("word", F.col("word").alias("pronunciation"), (F.col("n") / F.col("t")).alias("probability"), F.sqrt("n").alias("silence_after"))
    out = dictionary.merged_probabilities(rows, ("probability", "silence_after"))
    return out.select("word", "pronunciation", F.round("probability", 8).alias("probability"), F.round("silence_after", 8).alias("silence_after"), "n_dictionaries")


@query(f"SELECT word, array_to_string({_LETTERS}, ' ') AS pronunciation, array_to_string(list_filter(string_split(replace(word, 'th', 'z'), ''), lambda x: x <> ''), ' ') AS generated, levenshtein(word, replace(word, 'th', 'z')) AS edits FROM ({_WORDS})")
def validated_dictionary(t):
    """Given pronunciations beside generated ones, with the edits between them."""
    given = _lexicon(t).select("word", F.array_join("phones", " ").alias("pronunciation"))
    letters = F.filter(F.split(F.replace("word", F.lit("th"), F.lit("z")), ""), lambda x: x != "")
    return dictionary.validated(given, given.select("word", F.array_join(letters, " ").alias("pronunciation")))


@query("SELECT count(*) FILTER (c_mktsegment[1] = 'F') AS n_female, count(*) FILTER (c_mktsegment[1] = 'M') AS n_male, count(*) FILTER (c_mktsegment IS NULL OR c_mktsegment[1] NOT IN ('F', 'M')) AS n_unspecified FROM customer")
def sex_counts(t):
    """Speakers by the first letter of a field (here: customers by segment, of which some begin with f and m)."""
    return dictionary.sex_counts(t.customer, "c_mktsegment")


@query(f"WITH c AS (SELECT word, sum(n) AS n FROM ({_COUNTS}) GROUP BY word) SELECT CAST(coalesce(sum(n) FILTER (word IN ({_WORDS})), 0) AS BIGINT) AS n_speech, CAST(coalesce(sum(n) FILTER (word NOT IN ({_WORDS})), 0) AS BIGINT) AS n_oov, CAST(0 AS BIGINT) AS n_bracketed FROM c")
def word_type_totals(t):
    known = _lexicon(t).select("word", F.lit(True).alias("known"))
    rows = corpus.word_counts(t.documents, _text()).join(known, "word", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    return dictionary.bracketed_types(rows)


@query(
    f"SELECT CASE WHEN regexp_matches(phone, '{ARPA}') THEN 'ARPA' WHEN regexp_matches(phone, '{IPA_ONLY}') THEN 'IPA' WHEN regexp_matches(phone, '{PINYIN}') THEN 'PINYIN' ELSE 'UNKNOWN' END AS phone_set, count(*) AS n FROM "
    f"(SELECT DISTINCT unnest({_LETTERS}) AS phone FROM (SELECT DISTINCT word FROM ({_COUNTS}))) GROUP BY ALL"
)
def phone_set_vote(t):
    """Which phone set the letters of all words look like, by votes."""
    words = corpus.word_counts(t.documents, _text()).select(F.explode(F.filter(F.split("word", ""), lambda x: x != "")).alias("phone"))
    return phone_set_votes(words)


@query(
    f"WITH u AS (SELECT phone, count(*) AS n FROM (SELECT unnest({_LETTERS}) AS phone FROM ({_WORDS})) GROUP BY phone), p AS (SELECT phone FROM u), c AS (SELECT DISTINCT * FROM ({_CLASSES})) "
    "SELECT class, count(*) AS n_phones, CAST(sum(n) AS BIGINT) AS n_uses FROM c JOIN u USING (phone) GROUP BY class"
)
def dictionary_analysis(t):
    """Phones and their uses by class, as a model's card tells them."""
    uses = _lexicon(t).select(F.explode("phones").alias("phone")).groupBy("phone").agg(F.count("*").alias("n"))
    classes = dictionary.phone_classes(uses.select("phone"))
    return classes.join(uses, "phone").groupBy("class").agg(F.count("*").alias("n_phones"), F.sum("n").alias("n_uses"))


@query(f"SELECT conv_id, turn, coalesce(array_to_string(list_transform({_T}, lambda w: array_to_string(list_filter(string_split(w, ''), lambda x: x <> ''), ' ')), ', '), '') AS spelled FROM conversations")
def spelled_turns(t):
    """Nested lists as one text: the letters of each word of a turn."""
    letters = F.transform(_text(), lambda w: F.filter(F.split(w, ""), lambda x: x != ""))
    return t.conversations.select("conv_id", "turn", nested_text(letters).alias("spelled"))


def _stems_sql() -> str:
    """A list of (k, base, parts) for the column ``rest``, in the order of operators.dictionary."""
    out, k = ["{'k': 0, 'base': rest, 'parts': [rest]}"], 0
    for ending, olds in dictionary.ENDINGS:
        n = f"(length(rest) - {len(ending)})"
        fits = f"(suffix(rest, '{ending}') AND {n} > 1)"
        options = [(fits, f"rest[:{n}] || '{old}'") for old in olds]
        options += [(f"({fits} AND {n} > 2 AND rest[{n}] = rest[{n} - 1])", f"rest[:{n} - 1]"), (f"({fits} AND rest[{n}] = 'i')", f"rest[:{n} - 1] || 'y'")]
        for condition, base in options:
            k += 1
            out.append(f"{{'k': {k}, 'base': CASE WHEN {condition} THEN {base} END, 'parts': [{base}, '+{ending}']}}")
    return f"[{', '.join(out)}]"


_CUTS_SQL = ", ".join(
    f"{{'k': {k}, 'b': '{b}+', 'r': CASE WHEN starts_with(rest, '{b}') THEN regexp_replace(rest[{len(b) + 1}:], '^-', '') END}}" for k, b in enumerate(dictionary.BEGINNINGS)
)


@query(
    f"WITH RECURSIVE w AS (SELECT DISTINCT unnest({_T}) AS word FROM documents), v AS ({_WORDS}), "
    f"a AS (SELECT word, word AS rest, []::INTEGER[] AS path, []::VARCHAR[] AS front FROM w UNION ALL SELECT word, c.r, list_append(path, c.k), list_append(front, c.b) FROM (SELECT word, path, front, unnest([{_CUTS_SQL}]) AS c FROM a) WHERE c.r <> ''), "
    f"s AS (SELECT rest, unnest({_stems_sql()}) AS c FROM (SELECT DISTINCT rest FROM a)), "
    "b AS (SELECT rest, arg_min(c.parts, c.k) AS parts FROM s JOIN v ON v.word = c.base GROUP BY rest), "
    f"o AS (SELECT * FROM a WHERE len(path) = 0 UNION ALL SELECT word, c.r, list_append(path, c.k), list_append(front, c.b) FROM (SELECT word, path, front, unnest([{_CUTS_SQL}]) AS c FROM o WHERE rest NOT IN (SELECT rest FROM b)) WHERE c.r <> ''), "
    "f AS (SELECT word, list_concat(front, parts) AS parts, row_number() OVER (PARTITION BY word ORDER BY path) AS k FROM o JOIN b USING (rest)) "
    "SELECT word, array_to_string(coalesce(f.parts, [word]), ' ') AS parts FROM w LEFT JOIN (SELECT * FROM f WHERE k = 1) f USING (word)"
)
def affix_tokens(t):
    """Every word of the documents as a word of the benchmark and its affixes, where there is such a split."""
    words = t.documents.select(F.explode(_text()).alias("word"))
    vocabulary = t.benchmark.select(F.explode(_text()).alias("word"))
    return dictionary.split_affixes(words, vocabulary).select("word", F.array_join("parts", " ").alias("parts"))
