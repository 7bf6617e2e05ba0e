"""Best-fit packing of token pieces into sequences of a fixed capacity (operator 6).

Method: bulk-synchronous best fit. Pieces are range-sorted by length, longest first, which gives each its rank. A round takes the pieces of one length: they
sweep over the gaps, sorted by size, for their successors (each takes the smallest gap that holds it), conflicts are resolved
by rank (the r-th piece of a run takes the r-th place of a run of gaps), and the gaps are updated; rounds repeat down to the shortest length.
Neither sweep nor update needs more than runs: pieces of one length and gaps of one size in consecutive sequences are alike. So the rounds pass over
runs, whose number is bounded by the capacity and not by the documents, and all pieces take their places in one join of their ranks with the runs' ranks.
The result is that of best-fit decreasing, piece by piece.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import ship_package
from .common import held, stored, text_bytes, tidy, unused
from .encoding import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: only the first may be shorter."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = 2048, keep_words: bool = True) -> DataFrame:
    """The token pieces of every document: doc_id, piece, start, length, ids_crc32.

    Null text counts as empty (one piece with the end id alone). Other columns are ignored. keep_words: whether a worker
    keeps encoded words for its next task, which is faster, or gives their memory back after each.
    """
    ship_package(docs.sparkSession)
    tail = int(end_id).to_bytes(4, "little")

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = enc.encode(raw.as_py().decode("utf-8", "replace")) + tail
                for k, (start, length) in enumerate(cut_points(len(ids) // 4, capacity)):
                    row = (doc_id, k, start, length, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)]))
                    for column, x in zip(out, row, strict=True):
                        column.append(x)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in zip(out, kinds, strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )
        if not keep_words:
            enc.forget()

    return docs.select("doc_id", text_bytes().alias("raw")).mapInArrow(tidy(tokenise, cache=tokenizer_path), PIECES)


def sweep(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit by rounds over runs: (length, rank_from, rank_to, sequence, each, offset) of all pieces, by rank.

    counts: pieces of each length; ranks go from the longest piece to the shortest. A round takes one length. Gaps of equal size are runs of consecutive sequences,
    and the pieces sweep up the sizes from the smallest that holds them: a piece takes the smallest gap, which it leaves smaller still, so a gap takes as many as it holds (``each``)
    before the next one. The r-th piece of a row takes place r % each of sequence ``sequence`` + r // each, from ``offset`` on; two
    pieces never get one place, as ranks are parted. What finds no gap opens sequences. Then the gaps are updated for the next round.
    """
    gaps: dict[int, list[list[int]]] = {}  # size: intervals of sequences
    sizes: list[int] = []  # of the gaps, rising
    plan: list[tuple[int, int, int, int, int, int]] = []
    opened = rank = 0

    def give_back(size: int, low: int, high: int) -> None:
        if size <= 0 or low >= high:
            return
        if size not in gaps:
            gaps[size] = []
            insort(sizes, size)
        if gaps[size] and gaps[size][-1][1] == low:
            gaps[size][-1][1] = high
        else:
            gaps[size].append([low, high])

    def fill(length: int, left: int, size: int, low: int, high: int) -> int:
        """Pieces that an interval of gaps takes."""
        each = size // length
        whole, some = divmod(min(left, each * (high - low)), each)
        taken = whole * each + some
        plan.append((length, rank, rank + taken, low, each, capacity - size))
        give_back(size - each * length, low, low + whole)
        if some:
            give_back(size - some * length, low + whole, low + whole + 1)
        give_back(size, low + whole + bool(some), high)
        return taken

    for length in sorted(counts, reverse=True):
        left, at = counts[length], bisect_left(sizes, length)
        waiting = [(size, gaps[size]) for size in sizes[at:]]
        for size, intervals in waiting:
            if not left:
                break
            del gaps[size]
            sizes.remove(size)
            for low, high in intervals:
                if left:
                    taken = fill(length, left, size, low, high)
                    rank, left = rank + taken, left - taken
                else:
                    give_back(size, low, high)
        if left:
            fresh = -(-left // (capacity // length))
            taken = fill(length, left, capacity, opened, opened + fresh)
            rank, opened = rank + taken, opened + fresh
    return plan


def range_ranked(df: DataFrame, order: list, label: str, rank: str, n: int | None = None) -> DataFrame:
    """The rows (n at most) range-sorted and stored, with their place in the whole order. Ties get places of their own."""
    spot = unused(df, "_spot")
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(spot, F.monotonically_increasing_id())
    rows = stored(rows, label, n)
    part, inner = F.shiftright(spot, 33), F.col(spot).bitwiseAND(F.lit((1 << 33) - 1))
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # one row a partition
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("_part", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_shift"))
    return rows.join(F.broadcast(shifts), part == F.col("_part")).select(*df.columns, (F.col("_shift") + inner).alias(rank))


PLAN = ["_length", "rank_from", "rank_to", "sequence", "each", "place"]


def pack(piece_rows: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, length and more), gapless from 0.

    Lengths must lie in 1..capacity. Ties and repeated rows are placed in any order, nulls in other columns don't
    matter, columns named sequence_id or offset are replaced, an empty table gives an empty result. The driver gets one count a length (capacity rows at
    most) and broadcasts the rows of sweep(), whose number depends on the lengths that occur, not on how often.
    """
    # the row travels as one column, so that its names can't clash with those used here
    rows = piece_rows.select(F.struct("*").alias("row"), F.col("length").cast("long").alias("length"))
    rows = held(rows)  # range-sorting reads its rows twice
    docs = range_ranked(rows, [F.desc("length"), F.col("row.doc_id"), F.col("row.piece")], "pieces", "_rank")
    rows.unpersist()
    counts = {r["length"]: r["n"] for r in docs.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if any(x is None or not 1 <= x <= capacity for x in counts):
        raise ValueError("a piece is empty or longer than the capacity")
    # an Arrow table becomes a local relation; a list would start Python workers of another kind on the executors, which then stay
    runs = zip(*sweep(counts, capacity), strict=True) if counts else [[]] * len(PLAN)
    plan = F.broadcast(docs.sparkSession.createDataFrame(pa.table([pa.array(x, pa.int64()) for x in runs], PLAN)))
    placed = docs.join(plan, (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("rank_from")) & (F.col("_rank") < F.col("rank_to")))
    turn = F.col("_rank") - F.col("rank_from")
    kept = [F.col(f"row.`{c}`") for c in piece_rows.columns if c.lower() not in ("sequence_id", "offset")]
    return placed.select(
        *kept,
        (F.col("sequence") + F.floor(turn / F.col("each"))).alias("sequence_id"),
        (F.col("place") + turn % F.col("each") * F.col("length")).alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = 2048, keep_words: bool = True) -> DataFrame:
    """Pieces of all documents with their place: the operator as the query and the pipeline use it.

    Null texts count as empty (a piece of the end id alone); null ids pass through, repeated rows are packed each; other columns are ignored, an
    empty table gives an empty result.
    """
    return pack(pieces(docs, tokenizer_path, end_id, capacity, keep_words), capacity)
