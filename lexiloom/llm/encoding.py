"""Exact and fast use of the tokenizers library on long natural-language texts.

A text is cut only where its pre-tokenizer always cuts too, each distinct piece is encoded once
by the library, and a bounded cache in the Python worker keeps the ids. Cutting never changes
the ids: see ``WordwiseEncoder``.
"""

from __future__ import annotations

import json
import os
import re
from array import array

from .common import keep_cache

_LONE_SPACE = re.compile(r"(?<=\S)(?= \S)")

# fixed values: what the two pre-tokenizers do to ASCII and Latin-1 letters
_LATIN = "a-zß-öø-ÿ"
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
_SIMPLE = re.compile("[\n -~À-ÿ]*")
_WORD_TOKENS = re.compile(rf"{_CONTRACTIONS}|[{_LATIN}]+|[0-9]|[^\s{_LATIN}0-9]+")
_BOTH = f"{_LATIN}A-ZÀ-ÖØ-Þ"
#: Marks that are a pre-token of their own after a word and before white space.
_MARKS = ".,;:!?"
_BYTE_TOKENS = re.compile(rf"{_CONTRACTIONS}| ?[{_BOTH}]+| ?[0-9]+| ?[^\s{_BOTH}0-9]+|\s+(?!\S)|\s+")


_WORD_SPLIT = {
    "type": "Split",
    "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
    "behavior": "Removed",
    "invert": True,
}
_WORD_NORMAL = [("NFC", None), ("Replace", r"\s+"), ("Lowercase", None)]


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    same = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(same)]
    return {b: chr(b) for b in same} | {b: chr(256 + k) for k, b in enumerate(rest)}


_BYTE_LETTERS = _byte_letters()


def _mode(spec: dict) -> str:
    """How texts may be cut for a tokenizer file: see WordwiseEncoder."""
    pre, normalizer = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
    steps = pre.get("pretokenizers", [pre])
    plain = not spec.get("post_processor") and not any(x.get("normalized") or x.get("lstrip") or x.get("rstrip") or x.get("single_word") for x in spec.get("added_tokens") or [])
    if not plain or (spec.get("model") or {}).get("type") != "BPE":
        return "whole"
    if not normalizer and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
        return "keep_space"
    kinds = [(x.get("type"), x.get("pattern", {}).get("Regex")) for x in normalizer.get("normalizers", [])]
    if len(steps) == 2 and steps[0] == _WORD_SPLIT and steps[1].get("type") == "ByteLevel" and kinds == _WORD_NORMAL:
        return "drop_space"
    return "whole"


class WordwiseEncoder:
    """Ids of whole texts as little-endian uint32 bytes.

    keep_space (byte-level pre-tokenizer): a lone space between two non-spaces always starts
    a new pre-token, so cutting before it is exact. drop_space (split on words, white space
    removed): no pre-token spans white space, so cutting at plain spaces and newlines is
    exact. Any other tokenizer, or one whose normalizer or pattern isn't one of the two known ones, encodes the text
    whole. Strings of special tokens in a text become those tokens, as the library has it by default;
    special_as_text makes them ordinary text. Each of three caches keeps at most ``cache_entries``
    pieces of up to LONGEST characters, about 200 bytes each; ``forget`` drops them.
    """

    def __init__(self, path: str, cache_entries: int = 800_000, block_chars: int = 1_000_000, special_as_text: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_str(json.dumps(spec))
        self.tokenizer.encode_special_tokens = special_as_text
        self.cache_entries, self.block_chars = cache_entries, block_chars
        self.mode = _mode(spec)
        added = [] if special_as_text else [x["content"] for x in spec.get("added_tokens") or [] if x.get("content")]
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        self.mark = os.path.commonprefix(added)
        self.model = self.tokenizer.model
        self.first: dict[str, bytes] = {}
        self.rest: dict[str, bytes] = {}
        self.tokens: dict[str, bytes] = {}
        self.marks = {x: self._token(x) for x in _MARKS} if self.mode != "whole" else {}
        self.marked = False  # whether the block at hand has strings of special tokens

    #: Characters of the pieces that are kept.
    LONGEST = 64

    def forget(self) -> None:
        """Drops the caches."""
        self.first, self.rest, self.tokens = {}, {}, {}

    def _raw(self, pieces: list[str]) -> list[bytes]:
        """Ids by the whole tokenizer."""
        found = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in found]

    def _token(self, token: str) -> bytes:
        """Ids of one pre-token by the tokenizer's model."""
        letters = token.encode().decode("latin-1").translate(_BYTE_LETTERS)
        return array("I", [x.id for x in self.model.tokenize(letters)]).tobytes()

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces that no cache holds.

        For ASCII and Latin-1 letters, which neither normalizer changes but for case, the pre-tokens
        are cut here and only those not met before reach the model; other pieces take the whole way.
        """
        simple, special = _SIMPLE.fullmatch, self.special
        hard = [x for x in pieces if not simple(x)]
        if self.marked:
            hard += [x for x in pieces if simple(x) and special.search(x)]
        known = dict(zip(hard, self._raw(hard), strict=True)) if hard else {}
        if self.mode == "drop_space":
            cut = lambda x: _WORD_TOKENS.findall(x.lower())
        else:
            cut = _BYTE_TOKENS.findall
        fresh = {x: cut(x) for x in pieces if x not in known}
        if len(self.tokens) > self.cache_entries:
            self.tokens.clear()
        long, first, rest = [], self.first.get, self.rest.get
        for token in set().union(*fresh.values()).difference(self.tokens):
            met = rest(token[1:]) if token[0] == " " else first(token)  # a word that is a piece of its own is known there
            self.tokens[token] = met or self._token(token)
            if len(token) > self.LONGEST:
                long.append(token)
        ids = self.tokens.__getitem__
        out = [known[x] if x in known else b"".join(map(ids, fresh[x])) for x in pieces]
        for token in long:
            del self.tokens[token]
        return out

    def _look_up(self, pieces: list[str], cache: dict[str, bytes], prefix: str, edges: bool = True) -> bytes | None:
        """Ids of the pieces; without edges, None if a piece is empty or has white space at an end (such are never kept)."""
        missing = list(set(pieces).difference(cache))
        if not missing:
            return b"".join(map(cache.__getitem__, pieces))
        if not edges and any(not x or x != x.strip() for x in missing):
            return None
        if len(cache) + len(missing) > self.cache_entries:
            cache.clear()
            missing = list(set(pieces))
        drop, tokenize, space, marks = self.mode == "drop_space", self.model.tokenize, _BYTE_LETTERS[32] if prefix else "", self.marks
        other = []
        for x in missing:
            # ASCII letters are one pre-token and stand for themselves; a mark at their end is another one
            word, end = (x, b"") if x.isalpha() else (x[:-1], marks.get(x[-1:], b""))
            if word.isascii() and word.isalpha() and (end or word is x):
                low = word.lower() if drop else word
                ids = cache.get(low)
                if ids is None:
                    ids = array("I", [t.id for t in tokenize(space + low)]).tobytes()
                    cache[low] = ids
                cache[x] = ids + end
            else:
                other.append(x)
        if other:
            cache.update(zip(other, self._pieces([prefix + x for x in other]), strict=True))
        out = b"".join(map(cache.__getitem__, pieces))
        if max(map(len, missing)) >= self.LONGEST or len(cache) > self.cache_entries:
            for x in [x for x in missing for x in (x, x[:-1], x.lower(), x[:-1].lower())]:
                if len(x) >= self.LONGEST or len(cache) > self.cache_entries:
                    cache.pop(x, None)
        return out

    def _block(self, text: str) -> bytes:
        self.marked = self.special is not None and self.mark in text and self.special.search(text) is not None
        if self.mode == "drop_space":
            return self._look_up(text.replace("\n", " ").split(" "), self.first, "")
        head, *tail = text.split(" ")
        if not tail:
            return self._raw([text])[0]
        last = tail.pop()
        # a space beside other white space belongs to it: then only lone spaces are cut at
        if not head[-1:].isspace() and last and not last[0].isspace():
            found = self._look_up(tail, self.rest, " ", edges=False)
            if found is not None:
                end = self._raw([" " + last])[0] if last[-1].isspace() else self._look_up([last], self.rest, " ")
                start = (self._raw([head])[0] if head[0].isspace() else self._look_up([head], self.first, "")) if head else b""
                return start + found + end
        return self._look_up(_LONE_SPACE.split(text), self.first, "")

    def _blocks(self, text: str):
        """The text in blocks, cut at lone spaces only."""
        at = 0
        while len(text) - at > self.block_chars:
            end = at + self.block_chars
            while True:
                end = text.find(" ", end)
                if end < 0 or end + 1 >= len(text):
                    end = len(text)
                    break
                if not text[end - 1].isspace() and not text[end + 1].isspace():
                    break
                end += 1
            yield text[at:end]
            at = end
        yield text[at:]

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if self.mode == "whole":
            return self._raw([text])[0]
        return b"".join(map(self._block, self._blocks(text)))


_encoders: dict[str, WordwiseEncoder] = {}


def encoder(path: str) -> WordwiseEncoder:
    """One encoder a vocabulary file and Python worker; its caches stay as long as tasks name the path (``tidy``)."""
    if path not in _encoders:
        _encoders[path] = WordwiseEncoder(path)
    keep_cache(path, _encoders[path].forget)
    return _encoders[path]
