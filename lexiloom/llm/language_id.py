"""Language identification by a linear-chain conditional random field (operator 8).

Words are the positions of a chain and languages its labels. Affixes, character n-grams and
per-language lexicons give each word its scores; transitions are learned on chains that switch language, so
that text in several languages is labelled word by word. Forward-backward yields the probability of every
label at every word; a document gets the language with the largest mean.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import release_memory, text_bytes, tidy

UNDETERMINED = "und"
#: Features are hashed to this many weights a language.
DIMENSIONS = 1 << 18
#: Letters of a word; longer ones, as in scripts without spaces, are cut into pieces that take a place each.
LETTERS = 24
#: Features of a word at most: itself, its lexicons, 4 prefixes, 4 suffixes and its trigrams.
SLOTS = 10 + LETTERS
_STEP = np.uint64(0x9E3779B97F4A7C15)


def is_held_out(remainder: int = 2, modulus: int = 4):
    """Rows that no model learns from (null ids are not held out, nor learned from)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def cut_words(text: str) -> list[str]:
    """The text cut at white space, and words of more than LETTERS letters into pieces of as many."""
    tokens = text.split()
    if not tokens or max(map(len, tokens)) <= LETTERS:
        return tokens
    return [x[k : k + LETTERS] for x in tokens for k in range(0, len(x), LETTERS)]


def fold(token: str) -> str:
    """Lower-cased token from its first to its last letter; empty if it has none."""
    low = token.lower()
    if low.isalpha():
        return low
    letters = [k for k, c in enumerate(low) if c.isalpha()]
    return low[letters[0] : letters[-1] + 1] if letters else ""


def _slot(h: np.ndarray, kind: int) -> np.ndarray:
    h = (h ^ np.uint64(kind * 0x2545F4914F6CDD1D & (1 << 64) - 1)) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(46)).astype(np.int64)  # 18 bits


def word_features(words: list[str], lexicons: dict[str, int]) -> np.ndarray:
    """Hashed features [word, SLOTS] of folded words; unused slots hold DIMENSIONS."""
    clipped = [w[:LETTERS] for w in words]  # a letter may become two in lower case
    n = np.fromiter(map(len, clipped), np.int64, len(clipped))
    marked = np.array([f"\x02{w}\x03" for w in clipped], dtype=f"U{LETTERS + 2}")
    codes = marked.view(np.uint32).reshape(len(clipped), LETTERS + 2).astype(np.uint64)
    out = np.full((len(clipped), SLOTS), DIMENSIONS)
    powers = np.multiply.accumulate(np.full(LETTERS + 2, _STEP, np.uint64))
    out[:, 0] = _slot((codes * powers).sum(axis=1, dtype=np.uint64), 1)
    out[:, 1] = _slot(np.fromiter((lexicons.get(w, 0) for w in words), np.uint64, len(words)), 2)
    head = np.zeros(len(clipped), np.uint64)
    tail = head.copy()
    for k in range(1, 5):
        head = head * _STEP + codes[:, k]
        tail = tail * _STEP + np.take_along_axis(codes, np.maximum(n - k + 1, 0)[:, None], 1)[:, 0]
        fits = n >= k
        out[fits, 1 + k] = _slot(head, 10 + k)[fits]
        out[fits, 5 + k] = _slot(tail, 20 + k)[fits]
    grams = _slot((codes[:, :-2] * _STEP + codes[:, 1:-1]) * _STEP + codes[:, 2:], 3)
    fits = np.arange(LETTERS) < n[:, None]
    out[:, 10:][fits] = grams[fits]
    return out


def chain_marginals(emission: np.ndarray, valid: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """Label probabilities of chains [chain, place, label] by forward-backward.

    valid: [chain, place], a prefix of ones in each chain; the rest gets zeros.
    """
    n, length, labels = emission.shape
    local = np.exp(emission - emission.max(axis=2, keepdims=True))
    step = np.exp(transition)
    alpha = np.zeros((length, n, labels), emission.dtype)
    now = local[:, 0] / local[:, 0].sum(axis=1, keepdims=True)
    alpha[0] = now
    for t in range(1, length):
        now = (now @ step) * local[:, t]
        now /= now.sum(axis=1, keepdims=True)
        alpha[t] = now
    beta = np.ones((n, labels), emission.dtype)
    out = np.empty((length, n, labels), emission.dtype)
    out[-1] = alpha[-1]
    for t in range(length - 2, -1, -1):
        beta_next = (local[:, t + 1] * beta) @ step.T
        beta_next /= beta_next.sum(axis=1, keepdims=True)
        beta = np.where(valid[:, t + 1, None], beta_next, 1.0)
        out[t] = alpha[t] * beta
    out /= out.sum(axis=2, keepdims=True)
    return out.transpose(1, 0, 2) * valid[:, :, None]


@dataclass
class Crf:
    """A trained model: languages, weights [feature, label], transitions [from, to], lexicons."""

    languages: list[str]
    weights: np.ndarray
    transition: np.ndarray
    lexicons: dict[str, int]
    cache_words: int = 100_000
    chain: int = 64
    _rows: dict[str, int] = field(default_factory=dict)
    _table: np.ndarray | None = None
    _used: int = 1

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_rows", "_table")} | {"_rows": {}, "_table": None}

    def _emissions(self, tokens: list[str]) -> np.ndarray:
        """Table row of each raw token, good until the next call; rows are kept for the next texts. Row 0: no letter."""
        if self._table is None:
            self._table = np.zeros((1 << 12, len(self.languages)), np.float32)
            self._rows, self._used = {"": 0}, 1
        fresh = set(tokens).difference(self._rows)
        if fresh:
            if len(self._rows) + len(fresh) > self.cache_words and len(self._rows) > 1:
                self._rows, self._used, fresh = {"": 0}, 1, set(tokens)
            while self._used + len(fresh) > len(self._table):
                self._table = np.concatenate([self._table, np.zeros_like(self._table)])
            pairs = [(token, fold(token)) for token in fresh]
            self._rows.update((token, 0) for token, word in pairs if not word)
            pairs = [x for x in pairs if x[1]]
            first = self._used
            self._rows.update((token, first + k) for k, (token, _) in enumerate(pairs))
            for at in range(0, len(pairs), 4096):
                words = [word for _, word in pairs[at : at + 4096]]
                scores = self.weights[word_features(words, self.lexicons)].sum(axis=1)
                self._table[first + at : first + at + len(words)] = scores
            self._used += len(pairs)
        return np.fromiter(map(self._rows.__getitem__, tokens), np.int64, len(tokens))

    def _scores(self, tokens: list[str]) -> np.ndarray:
        """Scores [word, label] of the tokens with a letter. They are copies: the table may be filled anew for the next text."""
        rows = self._emissions(tokens)
        return self._table[rows[rows > 0]]

    def forget(self) -> None:
        """Drops the kept words, so that a worker holds them no longer than its task."""
        self._rows, self._table, self._used = {}, None, 1

    def label(self, text: str) -> tuple[list[str], np.ndarray]:
        """Words with letters and their label probabilities [word, label]."""
        tokens = cut_words(text)
        rows = self._emissions(tokens)
        kept = np.flatnonzero(rows)
        return [tokens[k] for k in kept], self._marginals([self._table[rows[kept]]])

    def _marginals(self, docs: list[np.ndarray]) -> np.ndarray:
        """Label probabilities of all words, document after document, from their scores.

        A document is cut into chains of equal length, so that no chain is longer than ``chain``
        whatever the document, and the chains of all documents run side by side.
        """
        sizes = np.array([len(x) for x in docs])
        chains = -(-sizes // self.chain)
        total = int(chains.sum())
        if not total:
            return np.zeros((0, len(self.languages)), np.float32)
        # word k of a document sits in chain k // chain; chains before it come from the documents before
        offset = np.repeat((np.cumsum(chains) - chains) * self.chain, sizes)
        inner = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        slot = offset + inner
        emission = np.zeros((total * self.chain, len(self.languages)), np.float32)
        emission[slot] = np.concatenate(docs)
        valid = np.zeros(total * self.chain, bool)
        valid[slot] = True
        shape = (total, self.chain)
        out = chain_marginals(emission.reshape(*shape, -1), valid.reshape(shape), self.transition)
        return out.reshape(total * self.chain, -1)[slot]

    def predict(self, texts: list[str], places: int = 40_000) -> list[tuple[str, float]]:
        """Language and score of each text, whole texts at any length.

        Texts go together up to ``places`` places of chains, of which a short text takes a whole chain.
        """
        out: list[tuple[str, float]] = []
        at = 0
        while at < len(texts):
            docs, size = [], 0
            while at + len(docs) < len(texts) and size < places and len(text := texts[at + len(docs)]) < 2_000_000:
                docs.append(self._scores(cut_words(text)))
                size += -(-len(docs[-1]) // self.chain) * self.chain
            if not docs:  # a very long text goes alone, in slices at white space
                out.append(self._predict_long(texts[at]))
                at += 1
                continue
            marginals = self._marginals(docs)
            ends = np.cumsum([len(x) for x in docs])
            for end, n in zip(ends, map(len, docs), strict=True):
                out.append(self._decide(marginals[end - n : end].sum(axis=0, dtype=np.float64), n))
            at += len(docs)
        return out

    def _predict_long(self, text: str, slice_chars: int = 1_000_000) -> tuple[str, float]:
        total, n, at = np.zeros(len(self.languages)), 0, 0
        while at < len(text):
            end = text.find(" ", at + slice_chars)
            end = len(text) if end < 0 else end
            scores = self._scores(cut_words(text[at:end]))
            total += self._marginals([scores]).sum(axis=0, dtype=np.float64)
            n, at = n + len(scores), end
        return self._decide(total, n)

    def _decide(self, total: np.ndarray, n: int) -> tuple[str, float]:
        if not n:
            return UNDETERMINED, 0.0
        best = int(np.argmax(total))
        return self.languages[best], min(1.0, max(0.0, float(total[best]) / n))


def fit(
    samples: list[tuple[str, str]],
    epochs: int = 4,
    words_a_text: int = 160,
    chain: int = 64,
    lexicon_words: int = 300,
    rate: float = 0.15,
    seed: int = 7,
) -> Crf:
    """A CRF from (text, language) pairs.

    A bounded sample: of each text a stretch of at most ``words_a_text`` words from a random place is learned from. Training
    chains are put together from stretches of 6 to 40 words of random texts, so they switch language; labels are
    those of the texts. Every language has a lexicon of its ``lexicon_words`` most frequent words. Adagrad on the
    log-likelihood.
    """
    rng = np.random.default_rng(seed)
    languages = sorted({lang for _, lang in samples})
    labels = len(languages)
    number = {x: k for k, x in enumerate(languages)}
    texts: list[tuple[list[str], int]] = []
    for text, lang in samples:
        words = [w for w in map(fold, cut_words(text)) if w]
        start = int(rng.integers(0, max(1, len(words) - words_a_text + 1)))
        if words := words[start : start + words_a_text]:
            texts.append((words, number[lang]))
    counts = [Counter(w for words, k in texts if k == label for w in words) for label in range(labels)]
    lexicons: dict[str, int] = {}
    for label, count in enumerate(counts):
        for word, _ in sorted(count.items(), key=lambda x: (-x[1], x[0]))[:lexicon_words]:
            lexicons[word] = lexicons.get(word, 0) | 1 << label

    # a set of languages as a number; sets that don't fit a word go by their hash
    lexicons = {w: m if m >> 62 == 0 else xxhash.xxh3_64_intdigest(m.to_bytes(labels // 8 + 1, "little")) for w, m in lexicons.items()}
    weights = np.zeros((DIMENSIONS + 1, labels), np.float32)  # the last row pads
    squares = np.full_like(weights, 1e-2)
    transition = np.zeros((labels, labels), np.float32)
    transition_squares = np.full_like(transition, 1e-2)
    names = sorted({w for words, _ in texts for w in words})
    known = dict(zip(names, word_features(names, lexicons), strict=True)) if names else {}

    for _ in range(epochs if texts else 0):
        stream: list[tuple[str, int]] = []
        for k in rng.permutation(len(texts)):
            words, label = texts[k]
            at = 0
            while at < len(words):
                size = int(rng.integers(6, 41))
                stream.append((words[at : at + size], label))
                at += size
        order = rng.permutation(len(stream))
        words = [(w, label) for k in order for w in stream[k][0] for label in (stream[k][1],)]
        chains = [words[k : k + chain] for k in range(0, len(words), chain)]
        for k in range(0, len(chains), 16):
            batch = chains[k : k + 16]
            n = len(batch)
            index = np.full((n, chain, SLOTS), DIMENSIONS)
            gold = np.zeros((n, chain), np.int64)
            valid = np.zeros((n, chain), bool)
            for i, one in enumerate(batch):
                for j, (word, label) in enumerate(one):
                    index[i, j], gold[i, j], valid[i, j] = known[word], label, True
            marginals = chain_marginals(weights[index].sum(axis=2), valid, transition)
            error = marginals.copy()
            np.put_along_axis(error, gold[:, :, None], np.take_along_axis(error, gold[:, :, None], 2) - 1, 2)
            error *= valid[:, :, None]
            flat, where = index.reshape(-1), np.repeat(error.reshape(-1, labels), SLOTS, axis=0)
            touched, back = np.unique(flat, return_inverse=True)
            grad = np.stack([np.bincount(back, where[:, c], len(touched)) for c in range(labels)], axis=1) / n
            squares[touched] += grad**2
            weights[touched] -= rate * grad / np.sqrt(squares[touched])
            weights[DIMENSIONS] = 0
            # expected transitions by the product of neighbouring marginals, observed ones counted
            both = valid[:, 1:] & valid[:, :-1]
            a, b = marginals[:, :-1][both], marginals[:, 1:][both]
            seen = np.zeros((labels, labels))
            np.add.at(seen, (gold[:, :-1][both], gold[:, 1:][both]), 1)
            joint = a[:, :, None] * np.exp(transition) * b[:, None, :]
            joint /= joint.sum(axis=(1, 2), keepdims=True)
            grad = (joint.sum(axis=0) - seen) / n
            transition_squares += grad**2
            transition -= (rate * grad / np.sqrt(transition_squares)).astype(np.float32)
    return Crf(languages, weights, transition, lexicons, chain=chain)


def train(docs: DataFrame, sample_per_language: int = 400, stretch: int = 4000, seed: int = 11) -> Crf | None:
    """A model from at most about ``sample_per_language`` labelled texts a language, ``stretch`` characters of each.

    Texts are drawn by a hash of doc_id among rows that are not held out, and so is the place of the stretch; only
    stretches reach the driver. None without any.
    """
    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").where(~is_held_out())
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    share = F.create_map(*(x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, sample_per_language / n)))))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    place = F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.greatest(F.length("text") - stretch, F.lit(0)) + 1) + 1
    text = F.substring("text", place.cast("int"), F.lit(stretch)).alias("text")
    picked = labelled.where(draw < share[F.col("lang")]).select("doc_id", text, "lang").toPandas()
    picked = picked.sort_values(["doc_id", "text"], kind="stable").drop_duplicates("text")
    model = fit(list(zip(picked["text"], picked["lang"], strict=True)))
    del picked
    release_memory()  # what training used on the driver
    return model


def identify(docs: DataFrame, model: Crf | None = None, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score and n_words for every row of docs.

    lang_pred is ``und`` with score 0 for null texts and texts without a letter (and where there was nothing
    to learn from). Only the text enters a prediction. Rows may repeat, other columns are
    ignored, an empty table gives an empty result.
    """
    model = model or train(docs, **options)
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIMENSIONS floats a language

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = shared.value
        for batch in batches:
            texts = [x.as_py().decode("utf-8", "replace") for x in batch.column(2)]
            found = tool.predict(texts) if tool else [(UNDETERMINED, 0.0)] * len(texts)
            columns = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *columns], names=["doc_id", "held_out", "lang_pred", "score"]
            )
        if tool:
            tool.forget()

    rows = docs.select(F.col("doc_id").cast("long"), is_held_out().alias("held_out"), text_bytes().alias("raw"))
    return rows.mapInArrow(tidy(work), "doc_id long, held_out boolean, lang_pred string, score double")


def label_words(docs: DataFrame, model: Crf) -> DataFrame:
    """doc_id and runs (lang, n_words, first word) of equal labels, for text that switches language.

    Null and empty texts, and those without a letter, have no runs. Rows may repeat, other columns are ignored.
    """
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("lang", pa.string()), ("n_words", pa.int64()), ("first", pa.string())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = shared.value
        for batch in batches:
            out = []
            for raw in batch.column(1):
                words, probability = tool.label(raw.as_py().decode("utf-8", "replace"))
                best = probability.argmax(axis=1) if len(words) else np.zeros(0, int)
                starts = np.flatnonzero(np.diff(best, prepend=-1))
                ends = [*starts[1:], len(words)] if len(starts) else []
                out.append(
                    [
                        {"lang": tool.languages[best[a]], "n_words": int(b - a), "first": words[a]}
                        for a, b in zip(starts, ends, strict=True)
                    ]
                )
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["doc_id", "runs"])

    rows = docs.select(F.col("doc_id").cast("long"), text_bytes().alias("raw"))
    return rows.mapInArrow(tidy(work), "doc_id long, runs array<struct<lang:string,n_words:long,first:string>>")


def keep_identified(docs: DataFrame, least_score: float = 0.4, **options) -> DataFrame:
    """The rows of docs whose language is determined with at least least_score, with all columns.

    The decision is made row by row while the rows pass through; nothing is joined. Null texts and texts without a letter go;
    repeated rows are decided alike, columns of any name pass through, an empty table stays empty. Without a label to learn from,
    nothing is determined and every row goes.
    """
    model = train(docs, **options)
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = shared.value
        for batch in batches:
            texts = [x or "" for x in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            found = tool.predict(texts) if tool else [(UNDETERMINED, 0.0)] * len(texts)
            yield batch.filter(pa.array([x[0] != UNDETERMINED and x[1] >= least_score for x in found], pa.bool_()))
        if tool:
            tool.forget()

    return docs.mapInArrow(tidy(work, most_bytes=1 << 20), docs.schema)
