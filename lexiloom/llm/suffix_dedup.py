"""Removal of repeated long byte strings by a logarithmic family of suffix arrays (operator 1).

A suffix here is the ``window`` (200) bytes from a place on; two places match over at least the window
if their suffixes are equal, and equal suffixes lie side by side in a suffix array.

1. Sampling. Each window has an anchor, the k-gram of the smallest hash inside it. Anchors depend on
   the bytes alone, so equal windows have equal anchors. Windows in a row with one anchor form
   a segment; a segment whose anchor occurs once in the corpus has no repeated window.
2. Segments with equal bytes repeat as a whole, however many there are; no further look is needed.
3. One segment of each distinct content, under an anchor with more than one content, goes to the
   suffix index, dealt by anchor. There every incoming batch gets its suffix array (by rank doubling, in the order of
   the bytes), is merge-scanned against the existing levels for matches, and levels of like size merge
   geometrically, by the places that the scan found. Matches there are decided on the bytes.
   An anchor with very many contents is dealt over several tasks; the last levels of those are
   compared with each other by an ordinary aggregate over 128-bit suffix hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import small_batches, stored, text_bytes, tidy

_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


class RollingHash:
    """Hashes of all k-byte strings of a block, modulo 2**64, mixed."""

    def __init__(self, which: int):
        rng = np.random.default_rng(1000 + which)
        self.table = rng.integers(0, 1 << 64, 256, np.uint64, endpoint=False) | np.uint64(1)
        self.base = _ODD[which]
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 1 << 16, 2 * len(self.up))
            for name, base in (("up", self.base), ("down", np.uint64(_inverse(int(self.base))))):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def prefix(self, block: np.ndarray) -> np.ndarray:
        self._powers(len(block) + 1)
        sums = np.zeros(len(block) + 1, np.uint64)
        np.cumsum(self.table[block] * self.up[: len(block)], out=sums[1:])
        return sums

    def at(self, sums: np.ndarray, k: int, places: np.ndarray | slice | None = None) -> np.ndarray:
        """Hashes of the k bytes from each place on (all places by default)."""
        if places is None:
            h = (sums[k:] - sums[:-k]) * self.down[: len(sums) - k]
        else:
            h = (sums[places + k] - sums[places]) * self.down[places]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        return h


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` values in a row (two running minima over blocks of the width)."""
    n = len(x)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    rows = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


class Segmenter:
    """Anchored segments of a text: see the module text."""

    def __init__(self, window: int = 200, kgram: int = 32, block: int = 1 << 20):
        self.window, self.kgram, self.block, self.hash = window, kgram, block, RollingHash(0)

    def segments(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """anchor hash, content hash, first window and number of windows of each segment."""
        found = [self._block(raw, at) for at in range(0, max(0, len(raw) - self.window + 1), self.block)]
        if not found:
            none = np.zeros(0, np.uint64)
            return none, none, np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _block(self, raw: bytes, at: int):
        part = np.frombuffer(raw, np.uint8)[at : at + self.block + self.window - 1]
        grams = self.hash.at(self.hash.prefix(part), self.kgram)
        # high bits rank the k-grams; the low ones hold the place, so the first of equals wins
        ranked = (grams >> np.uint64(24) << np.uint64(24)) | np.arange(len(grams), dtype=np.uint64)
        low = (sliding_min(ranked, self.window - self.kgram + 1) & np.uint64((1 << 24) - 1)).astype(np.int64)
        starts = np.concatenate([[0], np.flatnonzero(np.diff(low)) + 1])
        counts = np.diff(np.concatenate([starts, [len(low)]]))
        view = memoryview(raw)
        content = np.fromiter(
            (
                xxhash.xxh3_64_intdigest(view[a : a + n + self.window - 1])
                for a, n in zip((starts + at).tolist(), counts.tolist(), strict=True)
            ),
            np.uint64,
            len(starts),
        )
        return grams[low[starts]], content, starts + at, counts


def _ranks(keys: np.ndarray) -> np.ndarray:
    """The place of each key among the distinct keys."""
    order = np.argsort(keys)
    ordered = keys[order]
    ranks = np.empty(len(keys), np.uint64)
    ranks[order] = np.cumsum(np.concatenate([[False], ordered[1:] != ordered[:-1]]), dtype=np.uint64)
    return ranks


def suffix_order(block: np.ndarray, places: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, new): the places' windows in the order of their bytes, and whether each differs from the one before it.

    Ranks of 8 bytes at every place of the block give those of 24 bytes, and so on by threes; the last step lays
    its three parts over the window. Ranks are exact, so windows are told equal if and only if their bytes are.
    """
    if len(block) >= 1 << 21:
        raise ValueError("a block holds at most 2**21 bytes, so that three ranks fit a word")
    width = min(8, window)
    padded = np.concatenate([block, np.zeros(8, np.uint8)])
    words = np.ndarray((len(block),), ">u8", padded.tobytes(), strides=(1,)).astype(np.uint64)
    ranks = _ranks(words >> np.uint64(64 - 8 * width))

    def joined(at: np.ndarray, first: int, second: int) -> np.ndarray:
        end = len(block) - 1  # places past the end belong to no window
        return (ranks[at] << np.uint64(42)) | (ranks[np.minimum(at + first, end)] << np.uint64(21)) | ranks[np.minimum(at + second, end)]

    while 3 * width < window:
        ranks = _ranks(joined(np.arange(len(block)), width, 2 * width))
        width *= 3
    keys = joined(places, (window - width) // 2, window - width)
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    return order, np.concatenate([[True], ordered[1:] != ordered[:-1]])[: len(keys)]


class SuffixLevels:
    """Logarithmic family of suffix arrays over the distinct windows of a growing text.

    add() gives a batch its suffix array, marks what repeats inside it or in a level, and keeps one entry
    of each distinct window. Levels at least half as large as the one below merge, so a window
    takes part in a logarithmic number of merges.
    """

    #: Entries whose bytes are laid out at once.
    CHUNK = 1 << 14

    def __init__(self, window: int) -> None:
        self.window = window
        self.text = np.zeros(0, np.uint8)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # place in the text and number of each entry, in suffix order
        self.repeated = np.zeros(0, bool)

    def _windows(self, places: np.ndarray) -> np.ndarray:
        """The windows at these places as strings, which compare by their bytes."""
        view = np.lib.stride_tricks.sliding_window_view(self.text, self.window)
        return view[places].view(f"S{self.window}")[:, 0]

    def _scan(self, old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A merge scan of two arrays in suffix order: where each new entry goes among the old, and if it is there already."""
        spots, equal = np.zeros(len(new), np.int64), np.zeros(len(new), bool)
        at = 0  # old entries before it are smaller than all that is left
        for begin in range(0, len(new), self.CHUNK):
            wanted = self._windows(new[begin : begin + self.CHUNK])
            done = 0
            while done < len(wanted):
                have = self._windows(old[at : at + self.CHUNK])
                last = at + self.CHUNK >= len(old)
                stop = len(wanted) if last else done + int(np.searchsorted(wanted[done:], have[-1], side="right"))
                k = np.searchsorted(have, wanted[done:stop])
                inside = k < len(have)
                spots[begin + done : begin + stop] = at + k
                equal[begin + done : begin + stop][inside] = have[k[inside]] == wanted[done:stop][inside]
                done = stop
                if done < len(wanted):
                    at += self.CHUNK
        return spots, equal

    def add(self, block: np.ndarray, places: np.ndarray) -> None:
        """The windows at the places of a block of text; they get the next numbers."""
        first = len(self.repeated)
        self.repeated = np.concatenate([self.repeated, np.zeros(len(places), bool)])
        if not len(places):
            return
        order, new = suffix_order(block, places, self.window)
        run = np.cumsum(new) - 1
        self.repeated[first + order] = np.bincount(run)[run] > 1
        number, place = first + order[new], places[order[new]] + len(self.text)
        self.text = np.concatenate([self.text, block])
        for old_place, old_number in self.levels:
            spots, equal = self._scan(old_place, place)
            if equal.any():
                self.repeated[number[equal]] = True
                self.repeated[old_number[spots[equal]]] = True
                # the batch's repeats of that window were marked above; the level keeps its entry
                number, place = number[~equal], place[~equal]
        if not len(place):
            return
        self.levels.append((place, number))
        while len(self.levels) > 1 and 2 * len(self.levels[-1][0]) >= len(self.levels[-2][0]):
            (place, number), (old_place, old_number) = self.levels.pop(), self.levels.pop()
            spots, _ = self._scan(old_place, place)  # no window is in two levels
            self.levels.append((np.insert(old_place, spots, place), np.insert(old_number, spots, number)))


def _spans_of(mask: np.ndarray, first: int, window: int) -> list[tuple[int, int]]:
    """Byte spans covered by the repeated windows of a segment."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return [(first + int(a), first + int(b) - 1 + window) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs covered by the spans."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _keyed(docs: DataFrame) -> DataFrame:
    """docs as row (unique), doc_id and raw. Where doc_id is not unique, a numbered copy is stored."""
    docs = docs.select(F.col("doc_id").cast("long"), text_bytes().alias("raw"))
    odd = docs.groupBy("doc_id").count().where("doc_id IS NULL OR count > 1")
    if odd.limit(1).count():
        return stored(docs.select(F.monotonically_increasing_id().alias("row"), "*"), "numbered")
    return docs.select(F.col("doc_id").alias("row"), "*")


def repeated_spans(
    keyed: DataFrame, window: int = 200, contents_per_task: int = 4_000, kgram: int = 32
) -> DataFrame:
    """row, start, end of bytes covered by windows that start anywhere else too (spans may overlap)."""
    if not kgram <= window < kgram + 255:
        raise ValueError("a segment has at most window - kgram + 1 windows, and their number must fit a byte")
    spark = keyed.sparkSession
    ship_package(spark)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Segmenter(window, kgram)
        for batch in batches:
            rows, anchors, contents, places = [], [], [], []
            for row, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                anchor, content, first, n = tool.segments(raw.as_py())
                rows.append(np.full(len(anchor), row, np.int64))
                anchors.append(anchor)
                contents.append(content)
                places.append(first << 8 | n)
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(x).view(np.int64), pa.int64())
                        for x in (anchors, contents, rows, places)
                    ],
                    names=["anchor", "content", "row", "place"],
                )

    segments = stored(
        keyed.select("row", "raw").mapInArrow(tidy(sample), "anchor long, content long, row long, place long"), "segments"
    )
    often = stored(segments.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "anchors")
    shared = stored(segments.join(often, "anchor"), "shared")
    contents = stored(
        shared.groupBy("anchor", "content").agg(F.count("*").alias("n"), F.min(F.struct("row", "place")).alias("one")),
        "contents",
    )
    whole = shared.join(contents.where("n > 1").select("anchor", "content"), ["anchor", "content"])
    first, count = F.shiftright("place", 8), F.col("place").bitwiseAND(F.lit(255))
    whole = whole.select("row", first.alias("start"), (first + count - 1 + window).alias("end"))

    mixed = stored(contents.groupBy("anchor").agg(F.count("*").alias("m")).where("m > 1"), "mixed")
    salts = F.ceil(F.col("m") / contents_per_task)
    wanted = contents.join(mixed, "anchor").select(  # one a distinct content
        "anchor",
        F.pmod(F.xxhash64("content"), salts).alias("salt"),
        (salts > 1).alias("dealt"),
        F.col("one.row").alias("row"),
        F.col("one.place").alias("place"),
    )
    wanted = stored(wanted, "wanted")
    by_row = wanted.groupBy("row").agg(F.collect_list(F.struct("anchor", "salt", "dealt", "place")).alias("wanted"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for row, raw, wants in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                raw = raw.as_py()
                for x in wants.as_py():
                    at, n = x["place"] >> 8, x["place"] & 255
                    item = (x["anchor"], x["salt"], x["dealt"], row, x["place"], raw[at : at + n - 1 + window])
                    for column, value in zip(out, item, strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in zip(out, kinds, strict=True)],
                names=["anchor", "salt", "dealt", "row", "place", "bytes"],
            )

    fetched = (
        keyed.select("row", "raw")
        .join(by_row, "row")
        .mapInArrow(tidy(fetch), "anchor long, salt long, dealt boolean, row long, place long, bytes binary")
    )

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, hashes = SuffixLevels(window), (RollingHash(0), RollingHash(1))
        rows, places, dealt = [], [], []
        for batch in batches:
            for part in small_batches([batch], 1 << 20):  # a segment is shorter than two windows
                rows += part.column(0).to_pylist()
                places += (mine := part.column(1).to_pylist())
                dealt += part.column(2).to_pylist()
                texts = part.column(3).to_pylist()
                starts = np.cumsum([0, *map(len, texts)])[:-1]
                counts = np.array([p & 255 for p in mine])
                inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                levels.add(np.frombuffer(b"".join(texts), np.uint8), np.repeat(starts, counts) + inner)
        base = 0
        found: list[tuple[int, int, int]] = []
        owner: list[np.ndarray] = []
        for k, (row, place) in enumerate(zip(rows, places, strict=True)):
            n = place & 255
            if (mask := levels.repeated[base : base + n]).any():
                found += [(row, a, b) for a, b in _spans_of(mask, place >> 8, window)]
            if dealt[k]:
                owner.append(np.array([base, base + n, row, place >> 8], np.int64))
            base += n
        yield _index_rows([x[0] for x in found], [x[1] for x in found], [x[2] for x in found])
        # dealt anchors: one entry of each distinct suffix goes on, to meet those of other tasks
        if owner:
            table = np.array(owner)
            sums = [h.prefix(levels.text) for h in hashes]
            for place, at in levels.levels:
                k = np.searchsorted(table[:, 0], at, side="right") - 1
                mine = (k >= 0) & (at < table[np.maximum(k, 0), 1])
                h1, h2 = (h.at(x, window, place[mine]) for h, x in zip(hashes, sums, strict=True))
                at, k = at[mine], k[mine]
                start = table[k, 3] + at - table[k, 0]
                yield _index_rows(table[k, 2], start, start + window, h1, h2)

    # the last levels come back as rows with hashes; spans have none
    tasks = max(8, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    tasks = max(tasks, -(-wanted.count() // contents_per_task))
    indexed = stored(
        fetched.repartition(tasks, "anchor", "salt")
        .select("row", "place", "dealt", "bytes")
        .mapInArrow(tidy(index), "row long, start long, end long, h1 long, h2 long"),
        "indexed",
    )
    left = indexed.where("h1 IS NOT NULL")
    met = left.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2")
    across = left.join(met, ["h1", "h2"]).select("row", "start", "end")
    return whole.unionByName(indexed.where("h1 IS NULL").select("row", "start", "end")).unionByName(across)


def _index_rows(row, start, end, h1=None, h2=None) -> pa.RecordBatch:
    hashes = [
        pa.nulls(len(row), pa.int64()) if h is None else pa.array(h.view(np.int64), pa.int64()) for h in (h1, h2)
    ]
    return pa.RecordBatch.from_arrays(
        [pa.array(row, pa.int64()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), *hashes],
        names=["row", "start", "end", "h1", "h2"],
    )


def remove_repeats(docs: DataFrame, window: int = 200, contents_per_task: int = 4_000) -> DataFrame:
    """doc_id, n_bytes, removed (maximal runs as structs start, end) and kept (remaining bytes).

    Every byte covered by a window-byte string that also starts elsewhere, in the same document or
    another, is removed; strings are judged on the input. Null text counts as empty; texts shorter
    than the window lose nothing. Rows may repeat and share ids (all their copies repeat
    each other); other columns are ignored; an empty table gives an empty result.
    """
    keyed = _keyed(docs)
    spans = repeated_spans(keyed, window, contents_per_task)
    by_row = spans.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("spans"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs_kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            sizes, removed, kept = [], [], []
            for raw, spans in zip(batch.column(1), batch.column(2), strict=True):
                raw = raw.as_py()
                runs = merge_spans([(s["start"], s["end"]) for s in spans.as_py() or ()])
                sizes.append(len(raw))
                removed.append([{"start": a, "end": b} for a, b in runs])
                edges = [0, *(x for run in runs for x in run), len(raw)]
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, runs_kind), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "removed", "kept"],
            )

    return (
        keyed.join(by_row, "row", "left")
        .select("doc_id", "raw", "spans")
        .mapInArrow(tidy(apply), "doc_id long, n_bytes long, removed array<struct<start:long,end:long>>, kept binary")
    )


def digest(result: DataFrame) -> DataFrame:
    """The result of remove_repeats in numbers: n_removed, n_spans and the digest of what is left."""
    return result.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
