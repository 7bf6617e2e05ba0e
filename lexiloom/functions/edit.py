"""Edit distances over token lists, in Arrow batches."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def edits(a: Sequence, b: Sequence) -> int:
    """Insertions, deletions and substitutions between two sequences; a column of the table at a time, as the bits of whole numbers (Myers, Hyyrö)."""
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    places: dict = {}
    for i, v in enumerate(b):
        places[v] = places.get(v, 0) | 1 << i
    every, top, n = (1 << len(b)) - 1, 1 << len(b) - 1, len(b)
    up, down = every, 0  # where a column of the table rises by one from row to row, and where it falls
    for v in a:
        same = places.get(v, 0)
        across = same | down
        along = (((same & up) + up) ^ up) | same
        rise, fall = down | (every & ~(along | up)), up & along
        if rise & top:
            n += 1
        elif fall & top:
            n -= 1
        rise, fall = (rise << 1 | 1) & every, (fall << 1) & every
        up, down = (fall | ~(across | rise)) & every, rise & across
    return n


def token_edits(a: Column, b: Column) -> Column:
    """Edits between two token arrays; null counts as empty. Only one row's tokens are Python objects at a time."""

    @F.arrow_udf("long")
    def count(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([edits(p.as_py() or [], q.as_py() or []) for p, q in zip(x, y, strict=True)], pa.int64())

    return count(a, b)


def text_edits(a: Column, b: Column) -> Column:
    """Edits between the characters of two texts; null counts as empty."""

    @F.arrow_udf("long")
    def count(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([edits(p.as_py() or "", q.as_py() or "") for p, q in zip(x, y, strict=True)], pa.int64())

    return count(a, b)


def g2p_score(hypotheses: list[str], gold: list[str]) -> tuple[int, int]:
    """(edits, phones of the best gold): no edits where any hypothesis is right."""
    if set(hypotheses) & set(gold):
        return 0, len(next(g for g in gold if g in hypotheses).split())
    pairs = [(edits(h.split(), g.split()), len(g.split())) for h, g in product(hypotheses or [""], gold)]
    return min(pairs) if pairs else (0, 0)


def without_bracketed(words: Column) -> Column:
    return F.filter(words, lambda x: ~x.rlike(r"^[\[<{].*[\]>}]$"))
