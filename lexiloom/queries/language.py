"""Lexicon, language-model and error-rate queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.edit import token_edits
from ..functions.phones import strip_position, with_positions
from ..functions.text import tokens
from ..operators import language_model as lm
from ..operators import lexicon, metrics
from ..operators import ngram_model as ngm
from .base import one_byte_sql, query, tokens_sql

_T = tokens_sql()


def _text():
    return tokens(F.col("text"))


@query(
    f"SELECT lang, x[1] || ' ' || x[2] AS ngram, count(*) AS n FROM (SELECT lang, unnest(list_zip(a, a[2:])) AS x FROM (SELECT lang, {_T} AS a FROM documents)) WHERE x[2] IS NOT NULL GROUP BY ALL"
)
def ngram_counts_2(t):
    return lm.ngram_counts(t.documents, _text(), 2, "lang")


@query(
    f"SELECT lang, x[1] || ' ' || x[2] || ' ' || x[3] AS ngram, count(*) AS n FROM (SELECT lang, unnest(list_zip(a, a[2:], a[3:])) AS x FROM (SELECT lang, {_T} AS a FROM documents)) WHERE x[3] IS NOT NULL GROUP BY ALL"
)
def ngram_counts_3(t):
    return lm.ngram_counts(t.documents, _text(), 3, "lang")


_MODEL = (
    f"WITH w AS (SELECT lang, list_concat(['<s>'], {_T}, ['</s>']) AS a FROM documents), "
    "pairs AS (SELECT lang, x[1] AS history, x[2] AS word, count(*) AS n FROM (SELECT lang, unnest(list_zip(a, a[2:])) AS x FROM w) WHERE x[2] IS NOT NULL GROUP BY ALL), "
    "uni AS (SELECT lang, word, n, n / sum(n) OVER (PARTITION BY lang) AS p FROM (SELECT lang, word, CAST(sum(n) AS BIGINT) AS n FROM pairs GROUP BY ALL)), "
    "bi AS (SELECT lang, history, word, n, (n - 0.5) / sum(n) OVER (PARTITION BY lang, history) AS p FROM pairs), "
    "bo AS (SELECT b.lang, history, (1 - sum(b.p)) / nullif(1 - sum(u.p), 0) AS backoff FROM bi b JOIN uni u ON b.lang = u.lang AND b.word = u.word GROUP BY ALL), "
    f"bench AS (SELECT list_concat(['<s>'], {_T}, ['</s>']) AS a FROM benchmark), "
    "test AS (SELECT l.lang, x[1] AS history, x[2] AS word, count(*) AS n FROM (SELECT unnest(list_zip(a, a[2:])) AS x FROM bench), (SELECT DISTINCT lang FROM documents) l WHERE x[2] IS NOT NULL GROUP BY ALL), "
    "scored AS (SELECT t.*, coalesce(bi.p, coalesce(bo.backoff, 1) * uni.p) AS prob FROM test t LEFT JOIN bi ON t.lang = bi.lang AND t.history = bi.history AND t.word = bi.word "
    "LEFT JOIN uni ON t.lang = uni.lang AND t.word = uni.word LEFT JOIN bo ON t.lang = bo.lang AND t.history = bo.history) "
)


def _scored(t):
    pairs = t.benchmark.select(F.explode(lm.ngrams(lm.bounded(_text()), 2)).alias("g"))
    pairs = pairs.groupBy(F.col("g")[0].alias("history"), F.col("g")[1].alias("word")).agg(F.count("*").alias("n"))
    bigrams, unigrams = lm.tested_bigram_model(t.documents, _text(), "lang", pairs)
    test = t.documents.select("lang").distinct().crossJoin(pairs)  # every model scores the one test text
    return lm.backoff_probability(test, bigrams, unigrams, "lang")


@query(_MODEL + "SELECT lang, history, word, n, round(prob, 8) AS prob FROM scored")
def bigram_backoff_prob(t):
    return _scored(t).select("lang", "history", "word", "n", F.round("prob", 8).alias("prob"))


@query(
    _MODEL + "SELECT lang, round(exp(-sum(ln(prob) * n) FILTER (prob > 0) / sum(n) FILTER (prob > 0)), 4) AS perplexity, "
    "CAST(coalesce(sum(n) FILTER (prob IS NULL), 0) AS BIGINT) AS n_oov FROM scored GROUP BY lang"
)
def perplexity_by_lang(t):
    return lm.perplexity(_scored(t), "lang").select("lang", F.round("perplexity", 4).alias("perplexity"), "n_oov")


def _kneser_ney_sql(order: int) -> str:
    """Tables t1, t2, .. of adjusted counts and p1, p2, .. of probabilities, with discounts of 0.75."""
    w = [f"w{k}" for k in range(order)]
    lists = ", ".join(["a"] + [f"a[{k + 1}:]" for k in range(1, order)])
    out = f"WITH w AS (SELECT lang, list_concat(['<s>'], {_T}, ['</s>']) AS a FROM documents WHERE lang IS NOT NULL), "
    out += f"t{order} AS (SELECT lang, {', '.join(f'x[{k + 1}] AS w{k}' for k in range(order))}, count(*) AS n FROM (SELECT lang, unnest(list_zip({lists})) AS x FROM w) WHERE x[{order}] IS NOT NULL GROUP BY ALL), "
    for k in range(order - 1, 0, -1):
        out += (
            f"t{k} AS (SELECT lang, {', '.join(f'w{i + 1} AS w{i}' for i in range(k))}, count(*) AS n FROM t{k + 1} GROUP BY ALL UNION ALL "
            f"SELECT lang, {', '.join(f'a[{i + 1}] AS w{i}' for i in range(k))}, count(*) AS n FROM w WHERE len(a) >= {k} GROUP BY ALL), "
        )
    out += (
        "z AS (SELECT lang, sum(n) AS n, count(*) AS k FROM t1 WHERE w0 <> '<s>' GROUP BY lang), "
        "p1 AS (SELECT lang, w0, t1.n, CASE WHEN w0 <> '<s>' THEN (t1.n - 0.75::DOUBLE) / z.n + 0.75::DOUBLE * k / z.n / (k + 1) END AS p FROM t1 JOIN z USING (lang) "
        "UNION ALL SELECT lang, '<unk>', 0, 0.75::DOUBLE * k / n / (k + 1) FROM z)"
    )
    for k in range(2, order + 1):
        h, tail = ", ".join(w[: k - 1]), " AND ".join(f"l.w{i} = s.w{i + 1}" for i in range(k - 1))
        out += (
            f", h{k} AS (SELECT lang, {h}, sum(n) AS total, 0.75::DOUBLE * count(*) / sum(n) AS weight FROM t{k} GROUP BY ALL), "
            f"p{k} AS (SELECT s.lang, {', '.join(f's.w{i}' for i in range(k))}, s.n, (s.n - 0.75::DOUBLE) / total + weight * l.p AS p FROM t{k} s JOIN h{k} USING (lang, {h}) JOIN p{k - 1} l ON l.lang = s.lang AND {tail})"
        )
    parts = []
    for k in range(1, order + 1):
        history = f"concat_ws(' ', {', '.join(w[: k - 1])})" if k > 1 else "''"
        weight = f"weight FROM p{k} LEFT JOIN h{k + 1} USING (lang, {', '.join(w[:k])})" if k < order else f"NULL::DOUBLE FROM p{k}"
        parts.append(f'SELECT lang, {k} AS "order", {history} AS history, w{k - 1} AS word, n, p AS prob, {weight}'.replace("weight FROM", "weight AS backoff FROM", 1))
    return out + ", model AS (" + " UNION ALL ".join(parts) + ") "


_MODEL_ROWS = 'SELECT lang, CAST("order" AS INTEGER) AS "order", history, word, CAST(n AS BIGINT) AS n, round(prob, 8) AS prob, round(backoff, 8) AS backoff FROM model'


def _rounded(model):
    return model.select("lang", "order", "history", "word", "n", F.round("prob", 8).alias("prob"), F.round("backoff", 8).alias("backoff"))


@query(_kneser_ney_sql(2) + _MODEL_ROWS)
def kneser_ney_order_2(t):
    return _rounded(ngm.kneser_ney(t.documents, _text(), "lang", 2))


@query(_kneser_ney_sql(3) + _MODEL_ROWS)
def kneser_ney_order_3(t):
    """Back-off trigram model of each language."""
    return _rounded(ngm.kneser_ney(t.documents, _text(), "lang", 3))


@query(
    _kneser_ney_sql(2)
    + ", u AS (SELECT lang, word, prob FROM model WHERE \"order\" = 1), s AS (SELECT b.lang, b.history, b.word, b.n, b.prob AS p, u.prob AS q, coalesce(hu.prob, e.prob) AS ph, hb.weight AS a, "
    "1 - sum(b.prob) OVER g AS num, 1 - sum(u.prob) OVER g AS den FROM model b JOIN u ON b.lang = u.lang AND b.word = u.word JOIN u hu ON b.lang = hu.lang AND b.history = hu.word JOIN u e ON e.lang = b.lang AND e.word = '</s>' "
    "JOIN h2 hb ON hb.lang = b.lang AND hb.w0 = b.history WHERE b.\"order\" = 2 WINDOW g AS (PARTITION BY b.lang, b.history)), "
    "k AS (SELECT *, -ph * (p * (ln(q) + ln((num + p) / (den + q)) - ln(p)) + num * (ln((num + p) / (den + q)) - ln(a))) AS loss FROM s), "
    "kept AS (SELECT * FROM k WHERE exp(loss) - 1 >= 2e-6), bo AS (SELECT lang, history AS word, (1 - sum(p)) / nullif(1 - sum(q), 0) AS backoff FROM kept GROUP BY ALL) "
    "SELECT lang, CAST(1 AS INTEGER) AS \"order\", '' AS history, word, CAST(n AS BIGINT) AS n, round(prob, 8) AS prob, round(bo.backoff, 8) AS backoff FROM model m LEFT JOIN bo USING (lang, word) WHERE \"order\" = 1 "
    "UNION ALL SELECT lang, 2, history, word, n, round(p, 8), NULL FROM kept"
)
def pruned_bigram_model(t):
    """Bigram model without what changes its perplexity by less than two millionths."""
    return _rounded(ngm.pruned_kneser_ney(t.documents, _text(), "lang", 2e-6))


@query(
    _kneser_ney_sql(3)
    + f", b AS (SELECT list_concat(['<s>'], {_T}, ['</s>']) AS a FROM benchmark), l AS (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL), "
    "v AS (SELECT lang, word FROM model WHERE \"order\" = 1), "
    "g AS (SELECT lang, i, CASE WHEN i > 2 THEN a[i - 2] END AS h0, a[i - 1] AS h1, a[i] AS x FROM (SELECT a, unnest(range(2, len(a) + 1)) AS i FROM b), l), "
    "o AS (SELECT g.lang, CASE WHEN h0 IS NOT NULL THEN CASE WHEN v0.word IS NULL THEN '<unk>' ELSE h0 END END AS h0, CASE WHEN v1.word IS NULL THEN '<unk>' ELSE h1 END AS h1, CASE WHEN v2.word IS NULL THEN '<unk>' ELSE x END AS x, v2.word IS NULL AS oov "
    "FROM g LEFT JOIN v v0 ON v0.lang = g.lang AND v0.word = h0 LEFT JOIN v v1 ON v1.lang = g.lang AND v1.word = h1 LEFT JOIN v v2 ON v2.lang = g.lang AND v2.word = x), "
    "s AS (SELECT o.lang, oov, coalesce(m3.prob, coalesce(b3.weight, 1) * coalesce(m2.prob, coalesce(b2.weight, 1) * m1.prob)) AS p FROM o "
    "LEFT JOIN model m3 ON m3.\"order\" = 3 AND m3.lang = o.lang AND m3.history = h0 || ' ' || h1 AND m3.word = x LEFT JOIN h3 b3 ON b3.lang = o.lang AND b3.w0 = h0 AND b3.w1 = h1 "
    "LEFT JOIN model m2 ON m2.\"order\" = 2 AND m2.lang = o.lang AND m2.history = h1 AND m2.word = x LEFT JOIN h2 b2 ON b2.lang = o.lang AND b2.w0 = h1 "
    "LEFT JOIN model m1 ON m1.\"order\" = 1 AND m1.lang = o.lang AND m1.word = x) "
    "SELECT lang, count(*) AS n, count(*) FILTER (oov) AS n_oov, round(exp(-avg(ln(p))), 4) AS perplexity, round(exp(-avg(ln(p)) FILTER (NOT oov)), 4) AS perplexity_known FROM s GROUP BY lang"
)
def trigram_perplexity(t):
    """Perplexity of the benchmark's texts under each language's trigram model, unknown words with the mass of <unk>."""
    texts = t.benchmark.select("text").crossJoin(t.documents.where("lang IS NOT NULL").select("lang").distinct())  # a row a language
    out = ngm.trained_perplexity(t.documents, texts, _text(), "lang", 3)
    return out.select("lang", "n", "n_oov", F.round("perplexity", 4).alias("perplexity"), F.round("perplexity_known", 4).alias("perplexity_known"))


_TURNS = (
    f"SELECT conv_id, unnest({_T}) AS word, turn, generate_subscripts({_T}, 1) AS place FROM conversations"
)


def _words_of_turns(t):
    rows = t.conversations.select("conv_id", "turn", "role", F.posexplode(_text()).alias("place", "word"))
    return rows.withColumn("at", F.col("turn") * 1_000_000 + F.col("place"))


@query(
    f"WITH w AS (SELECT *, word IN ('the', 'a', 'of', 'de', 'la', 'und', 'der') AS sil FROM ({_TURNS})), "
    "n AS (SELECT word, sil, coalesce(lead(sil) OVER o, true) AS after, coalesce(lag(sil) OVER o, true) AS before FROM w WINDOW o AS (PARTITION BY conv_id ORDER BY turn, place)) "
    "SELECT word, count(*) AS n, count(*) FILTER (after) AS sil_after, count(*) FILTER (NOT after) AS non_after, count(*) FILTER (before) AS sil_before, count(*) FILTER (NOT before) AS non_before FROM n WHERE NOT sil GROUP BY word"
)
def next_prev_silence(t):
    """Words by whether a pause (here: a function word) stands next to them."""
    pause = F.col("word").isin("the", "a", "of", "de", "la", "und", "der")
    return lexicon.pronunciation_counts(_words_of_turns(t), ["conv_id"], "at", pause)


@query()
def pronunciation_probabilities(t):
    pause = F.col("word").isin("the", "a", "of", "de", "la", "und", "der")
    counts = lexicon.pronunciation_counts(_words_of_turns(t), ["conv_id"], "at", pause)
    return lexicon.pronunciation_probabilities(counts.withColumn("initial", F.substring("word", 1, 1)), "initial")


_LEXICON = f"SELECT DISTINCT word, array_to_string(list_filter(string_split(word, ''), lambda x: x <> ''), ' ') AS pronunciation FROM (SELECT unnest({_T}) AS word FROM benchmark)"


def _lexicon(t):
    words = t.benchmark.select(F.explode(_text()).alias("word")).distinct()
    letters = F.filter(F.split("word", ""), lambda x: x != "")
    return words.select("word", F.array_join(letters, " ").alias("pronunciation"), letters.alias("phones"))


@query(
    f"SELECT word, pronunciation, trim(regexp_replace(regexp_replace(' ' || pronunciation || ' ', ' t h ', ' θ ', 'g'), ' t h ', ' θ ', 'g')) AS applied FROM ({_LEXICON})"
)
def rule_expansion(t):
    """One pass of the rule t h -> θ over every pronunciation."""
    return _lexicon(t).select("word", "pronunciation", lexicon.apply_rule(F.col("pronunciation"), "t h", "", "", "θ").alias("applied"))


_RULES = [("t h", "", "", "θ"), ("θ", "^", "", "t"), ("e", "", "$", ""), ("n d", "", "$", "n"), ("n", "a", "", "m"), ("t", "s", "h", "")]
#: The same rules over phones that each have a space of their own on both sides, so that matches don't share spaces.
_RULES_SQL = ", ".join(
    f"{{'k': {k}, 'q': regexp_replace(p, '{pattern}', '{made}', 'g')}}"
    for k, (pattern, made) in enumerate(
        [(" t  h ", " θ "), ("^ θ ", " t "), (" e $", ""), (" n  d $", " n "), (" a  n ", " a  m "), (" s  t  h ", " s  h ")]
    )
)


@query(
    f"WITH RECURSIVE l AS ({_LEXICON}), r AS (SELECT word, ' ' || replace(pronunciation, ' ', '  ') || ' ' AS p, [' ' || replace(pronunciation, ' ', '  ') || ' '] AS visited, []::INTEGER[] AS path FROM l "
    "UNION ALL SELECT word, s.q, list_append(visited, s.q), list_append(path, s.k) FROM "
    f"(SELECT word, visited, path, unnest([{_RULES_SQL}]) AS s FROM r) WHERE s.q <> '' AND NOT list_contains(visited, s.q)), "
    "k AS (SELECT word, p, path, row_number() OVER (PARTITION BY word, p ORDER BY len(path), path) AS k FROM r) "
    "SELECT word, replace(trim(p), '  ', ' ') AS pronunciation, len(path) > 0 AS generated, array_to_string(list_sort(list_distinct(path)), ' ') AS rules, "
    "CAST(len(path) AS INTEGER) AS depth FROM k WHERE k = 1"
)
def rule_closure(t):
    """All variants of every word under rules that feed each other, each with the rules on the way to it."""
    made = lexicon.expand_rules(_lexicon(t).select("word", "pronunciation"), _RULES)
    return made.select("word", "pronunciation", "generated", F.array_join("rules", " ").alias("rules"), "depth")


@query(
    f"SELECT word, array_to_string(p[1:k], ' ') AS prefix FROM (SELECT word, string_split(pronunciation, ' ') AS p, unnest(range(1, len(string_split(pronunciation, ' ')) + 1)) AS k FROM ({_LEXICON}))"
)
def prefix_pronunciations(t):
    rows = _lexicon(t).select("word", F.explode(lexicon.prefixes(F.col("phones"))).alias("p"))
    return rows.select("word", F.array_join("p", " ").alias("prefix"))


@query(
    f"WITH RECURSIVE l AS (SELECT word, string_split(pronunciation, ' ') AS p FROM ({_LEXICON})), r AS (SELECT word, p, 1 AS k, '' AS made FROM l UNION ALL "
    "SELECT word, p, k + 1, made || CASE WHEN made = '' THEN '' ELSE ' ' END || o FROM (SELECT *, unnest(CASE p[k] WHEN 'q' THEN ['k', 'kw'] WHEN 'c' THEN ['k', 's'] WHEN 'z' THEN ['s'] ELSE [p[k]] END) AS o FROM r WHERE k <= len(p))) "
    "SELECT word, made AS pronunciation, count(*) AS n FROM r WHERE k > len(p) GROUP BY word, made"
)
def remap_tokens_product(t):
    rows = _lexicon(t).withColumn("probability", F.lit(1.0))
    out = lexicon.remap_alternatives(rows, {"q": ["k", "kw"], "c": ["k", "s"], "z": ["s"]})
    return out.select("word", F.array_join("phones", " ").alias("pronunciation"), "n")


@query(
    f"SELECT word, CASE WHEN len(word) = 1 THEN word || '_S' ELSE word[1] || '_B' END AS first, word[1] AS stripped FROM (SELECT DISTINCT word FROM ({_LEXICON}))"
)
def phone_positions(t):
    first = F.get(with_positions(F.col("phones")), 0)
    return _lexicon(t).select("word", first.alias("first"), strip_position(first).alias("stripped"))


def _turn_pairs(t):
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = t.conversations.select("conv_id", "turn", _text().alias("gold"), F.lead(_text()).over(w).alias("hyp"))
    return rows.withColumn("hyp", F.coalesce("hyp", F.array().cast("array<string>")))


@query()
def word_error_rate(t):
    """Each turn against the next as its hypothesis: edits, words, and corpus totals by hand in tests."""
    rows = metrics.error_counts(_turn_pairs(t), "gold", "hyp")
    return rows.select("conv_id", "turn", "word_edits", "n_words", "char_edits", "n_chars")


@query(
    f"WITH w AS (SELECT conv_id, turn, array_to_string({_T}, '') AS g, coalesce(lead(array_to_string({_T}, '')) OVER (PARTITION BY conv_id ORDER BY turn), '') AS h FROM conversations) "
    f"SELECT conv_id, turn, levenshtein({one_byte_sql('g')}, {one_byte_sql('h')}) AS char_edits, length(g) AS n_chars FROM w"
)
def char_error_rate(t):
    """Character edits of each turn against the next as its hypothesis."""
    return metrics.error_counts(_turn_pairs(t), "gold", "hyp").select("conv_id", "turn", "char_edits", "n_chars")


@query()
def error_rate_report(t):
    """Corpus error rates with their severity."""
    return metrics.error_report(metrics.error_counts(_turn_pairs(t), "gold", "hyp"))


@query()
def token_edit_distance(t):
    rows = _turn_pairs(t)
    return rows.select("conv_id", "turn", token_edits(F.col("gold"), F.col("hyp")).alias("edits"))
