"""Operators over intervals (begin, end in integer microseconds) within a key.

Order-dependent steps are windows or islands of windows; joins on time go through time buckets, so a hot key
spreads over its buckets and a join never pairs a whole key with itself. A window sorts a key in one task, by disk where it is
long: keys are utterances, files or conversations, whose rows are bounded by their duration.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .corpus import dense_ids

EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, {ts})")


def statistics(rows: DataFrame, label: str, value: Column) -> DataFrame:
    """label, n, mean, sd of the natural log of positive values; sd is null for one value."""
    log = F.ln(value)
    return rows.where(value > 0).groupBy(label).agg(
        F.count("*").alias("n"), F.avg(log).alias("mean"), F.stddev_samp(log).alias("sd")
    )


def zscores(rows: DataFrame, label: str, value: Column) -> DataFrame:
    """rows with z, the deviation of a log value from its label's mean; null without a spread."""
    stats = statistics(rows, label, value)
    z = (F.ln(value) - F.col("mean")) / F.nullif(F.col("sd"), F.lit(0.0))
    return rows.where(value > 0).join(stats, label).withColumn("z", z).drop("n", "mean", "sd")


def runs(rows: DataFrame, key: Sequence[str], order: Sequence[str], flag: Column) -> DataFrame:
    """Maximal runs of rows whose flag holds: key, run, first and last order value, n."""
    w = Window.partitionBy(*key).orderBy(*order)
    marked = rows.withColumn("_on", F.coalesce(flag, F.lit(False)))
    marked = marked.withColumn("_run", F.sum(F.when(F.col("_on"), 0).otherwise(1)).over(w)).where("_on")
    return marked.groupBy(*key, "_run").agg(
        F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count("*").alias("n")
    )


def utterance_quality(rows: DataFrame, key: str, label: str, order: Sequence[str], duration: str, power: str, silence: Column, goodness: str, shortest: float) -> DataFrame:
    """key, n, mean_goodness, duration_deviation, power_deviation, snr, longest_short_run of each utterance's intervals.

    The deviations are the largest distances of an interval's log duration and log power from the means of its label over all rows, in standard deviations. snr: decibels of the
    mean power outside silence over that of silence (without silence: over the least power). The run is the longest row of intervals shorter than ``shortest``. Intervals without a
    positive duration (power) count for no deviation.
    """
    worst = lambda column, name: zscores(rows, label, F.col(column)).groupBy(key).agg(F.max(F.abs("z")).alias(name))
    speech = F.avg(F.when(~silence, F.col(power)))
    noise = F.coalesce(F.avg(F.when(silence, F.col(power))), F.min(power))
    sums = rows.groupBy(key).agg(F.count("*").alias("n"), F.avg(goodness).alias("mean_goodness"), (decibel(speech) - decibel(noise)).alias("snr"))
    short = runs(rows, [key], order, F.col(duration) < shortest).groupBy(key).agg(F.max("n").alias("longest_short_run"))
    out = sums.join(worst(duration, "duration_deviation"), key, "left").join(worst(power, "power_deviation"), key, "left").join(short, key, "left")
    return out.withColumn("longest_short_run", F.coalesce("longest_short_run", F.lit(0).cast("long")))


def hysteresis(rows: DataFrame, key: Sequence[str], order: Sequence[str], value: Column, on: float, off: float) -> DataFrame:
    """Runs of rows that are active: a value above ``on`` activates, one below ``off`` ends it."""
    w = Window.partitionBy(*key).orderBy(*order)
    state = F.last(F.when(value > on, True).when(value < off, False), ignorenulls=True).over(w)
    return runs(rows.withColumn("_state", state), key, order, F.col("_state"))


def fill_gaps(rows: DataFrame, key: Sequence[str], label: str = "sil", edges: DataFrame | None = None) -> DataFrame:
    """key, begin, end, label: a row for every stretch between intervals that none covers.

    edges (key, first, last): bounds of each key, up to which its start and end are filled too; a key without an interval is
    filled as a whole.
    """
    w = Window.partitionBy(*key).orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.max("end").over(w)
    gaps = rows.withColumn("_covered", covered).where("_covered < begin")
    out = gaps.select(*key, F.col("_covered").alias("begin"), F.col("begin").alias("end"))
    if edges is not None:
        ends = edges.join(rows.groupBy(*key).agg(F.min("begin").alias("_b"), F.max("end").alias("_e")), list(key), "left")
        before = ends.select(*key, F.col("first").alias("begin"), F.coalesce("_b", "last").alias("end"))
        after = ends.where("_e IS NOT NULL").select(*key, F.col("_e").alias("begin"), F.col("last").alias("end"))
        out = out.unionByName(before.unionByName(after).where("begin < end"))
    return out.withColumn("label", F.lit(label))


def merge_close(rows: DataFrame, key: Sequence[str], gap: int) -> DataFrame:
    """Intervals joined where the next begins within ``gap`` of all before: key, begin, end, labels, n."""
    marked = _islands(rows, key, gap)
    return marked.groupBy(*key, "_island").agg(
        F.min("begin").alias("begin"),
        F.max("end").alias("end"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("begin", "end", "label"))), lambda x: x["label"]), " ").alias("labels"),
        F.count("*").alias("n"),
    ).drop("_island")


def _islands(rows: DataFrame, key: Sequence[str], gap: int) -> DataFrame:
    w = Window.partitionBy(*key).orderBy("begin", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(before.isNull() | (F.col("begin") - before > gap), 1).otherwise(0)
    return rows.withColumn("_fresh", fresh).withColumn("_island", F.sum("_fresh").over(w)).drop("_fresh")


def merge_segments(rows: DataFrame, key: Sequence[str], pause: int, longest: int, shortest: int = 0, snap: int = 0) -> DataFrame:
    """Segments of intervals: a new one starts after a pause or where it would get too long.

    Segments shorter than ``shortest`` are dropped, then each is made ``snap`` longer at both ends, as far as half the way to
    its neighbour and not below zero.

    A long pause always starts one, so stretches between pauses are independent; only inside a stretch
    the cut depends on what came before and runs in order (Arrow batches of whole stretches).
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*key).schema)

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["begin", "end"], kind="stable")
        out: list[list] = []
        for begin, end in zip(pdf["begin"], pdf["end"], strict=True):
            if out and end - out[-1][0] <= longest:
                out[-1][1] = max(out[-1][1], end)
                out[-1][2] += 1
            else:
                out.append([begin, end, 1])
        made = pd.DataFrame(out, columns=["begin", "end", "n"])
        for name in reversed(key):
            made.insert(0, name, pdf[name].iloc[0])
        return made

    stretches = _islands(rows.select(*key, "begin", "end"), key, pause)
    made = stretches.groupBy(*key, "_island").applyInPandas(cut, f"{schema}, begin long, end long, n long")
    made = made.where(F.col("end") - F.col("begin") >= shortest)
    if not snap:
        return made
    w = Window.partitionBy(*key).orderBy("begin", "end")
    half = lambda gap: F.least(F.lit(snap), F.floor(F.greatest(gap, F.lit(0)) / 2))
    last, following = F.lag("end").over(w), F.lead("begin").over(w)
    before = F.when(last.isNotNull(), half(F.col("begin") - last)).otherwise(F.least(F.lit(snap), F.col("begin")))
    after = F.when(following.isNotNull(), half(following - F.col("end"))).otherwise(F.lit(snap))
    moved = made.withColumns({"_before": before.cast("long"), "_after": after.cast("long")})
    return moved.select(*key, (F.col("begin") - F.col("_before")).alias("begin"), (F.col("end") + F.col("_after")).alias("end"), "n")


def inside(rows: DataFrame, outer: DataFrame, key: Sequence[str], bucket: int, outer_id: str) -> DataFrame:
    """rows with the id of every interval of ``outer`` (key, begin, end, id) that holds them as a whole."""
    spread = outer.select(
        *key, F.col(outer_id), F.col("begin").alias("_b"), F.col("end").alias("_e"),
        F.explode(F.sequence(F.floor(F.col("begin") / bucket), F.floor(F.col("end") / bucket))).alias("_bucket"),
    )
    located = rows.withColumn("_bucket", F.floor(F.col("begin") / bucket))
    return located.join(spread, [*key, "_bucket"]).where("begin >= _b AND end <= _e").drop("_bucket", "_b", "_e")


def mask_cutoffs(phones: DataFrame, cutoffs: DataFrame, key: Sequence[str], bucket: int, unknown: str = "spn") -> DataFrame:
    """Phones without those that a cut-off word intersects, and one unknown phone over each such word (key, begin, end, label)."""
    kept = without_overlap(phones, cutoffs, key, bucket)
    masks = cutoffs.where("end > begin").select(*key, "begin", "end", F.lit(unknown).alias("label"))
    return kept.select(*key, "begin", "end", "label").unionByName(masks)


def attached(intervals: DataFrame, utterances: DataFrame, key: Sequence[str], bucket: int, label: str = "sil") -> DataFrame:
    """utterance, begin, end, label: reference intervals by the utterance that holds their middle, gaps and edges filled.

    utterances: key, begin, end, utterance. Intervals that no utterance holds are left out, and ends are cut to the utterance's.
    """
    middle = intervals.withColumn("_mid", F.floor((F.col("begin") + F.col("end")) / 2))
    middle = middle.select(*key, "_mid", F.col("begin").alias("_from"), F.col("end").alias("_to"), "label")
    found = contained(middle, utterances, key, "_mid", bucket).select(
        "utterance", F.greatest("_from", "begin").alias("begin"), F.least("_to", "end").alias("end"), "label"
    )
    edges = utterances.select("utterance", F.col("begin").alias("first"), F.col("end").alias("last"))
    return found.unionByName(fill_gaps(found, ["utterance"], label, edges))


def equal_alignment(utterances: DataFrame, frames: str, labels: str) -> DataFrame:
    """rows, place, label, first, last: an utterance's frames dealt evenly over its labels, as a first alignment is made."""
    n = F.size(labels)
    rest = [c for c in utterances.columns if c not in (frames, labels)]
    rows = utterances.select(*rest, F.col(frames).alias("_f"), n.alias("_n"), F.posexplode(labels).alias("place", "label"))
    at = lambda k: F.floor(F.col("_f") * k / F.col("_n"))
    return rows.select(*rest, "place", "label", at(F.col("place")).alias("first"), (at(F.col("place") + 1) - 1).alias("last"))


def mean_variance_normalized(frames: DataFrame, key: str, vector: str) -> DataFrame:
    """frames with ``normalized``: each dimension less its mean, by its spread, over all frames of the key (speaker)."""
    flat = frames.select(key, F.posexplode(vector).alias("_i", "_x"))
    stats = flat.groupBy(key, "_i").agg(F.avg("_x").alias("m"), F.stddev_pop("_x").alias("s"))
    listed = stats.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_i", "m", "s"))).alias("_stats"))
    out = F.zip_with(vector, "_stats", lambda x, st: F.when(st["s"] > 0, (x - st["m"]) / st["s"]).otherwise(F.lit(0.0)))
    return frames.join(listed, key).withColumn("normalized", out).drop("_stats")


def confirmed_by_energy(segments: DataFrame, frames: DataFrame, key: Sequence[str], bucket: int, least: Column) -> DataFrame:
    """Segments (key, begin, end) whose frames (key, at, energy) are loud enough on average, with that average."""
    held = contained(frames, segments, key, "at", bucket)
    means = held.groupBy(*key, "begin", "end").agg(F.avg("energy").alias("energy"), F.count("*").alias("n_frames"))
    return means.where(F.col("energy") >= least)


def spans_of(children: DataFrame, parent: str) -> DataFrame:
    """parent, begin, end: from the first begin to the last end of its children, as after boundaries were moved."""
    return children.groupBy(parent).agg(F.min("begin").alias("begin"), F.max("end").alias("end"))


def contained(points: DataFrame, intervals: DataFrame, key: Sequence[str], at: str, bucket: int) -> DataFrame:
    """Pairs of a point and an interval of its key with begin <= point < end.

    bucket: width of a time bucket, best near the usual length of an interval.
    """
    spread = intervals.withColumn(
        "_bucket", F.explode(F.sequence(F.floor(F.col("begin") / bucket), F.floor((F.col("end") - 1) / bucket)))
    )
    located = points.withColumn("_bucket", F.floor(F.col(at) / bucket))
    return located.join(spread, [*key, "_bucket"]).where((F.col(at) >= F.col("begin")) & (F.col(at) < F.col("end"))).drop("_bucket")


def without_overlap(rows: DataFrame, blockers: DataFrame, key: Sequence[str], bucket: int) -> DataFrame:
    """Intervals that no blocker of their key intersects."""
    span = lambda: F.explode(F.sequence(F.floor(F.col("begin") / bucket), F.floor((F.col("end") - 1) / bucket)))
    wide = blockers.where("end > begin").select(*key, F.col("begin").alias("_b"), F.col("end").alias("_e"), span().alias("_bucket"))
    mine = rows.withColumn("_bucket", span())
    ids = [c for c in rows.columns]
    hit = mine.join(wide, [*key, "_bucket"]).where("end > _b AND begin < _e").select(*ids).distinct()
    return rows.join(hit, ids, "left_anti")


def as_of(left: DataFrame, right: DataFrame, key: Sequence[str], at: str, value: str) -> DataFrame:
    """left with the value of the last row of right at or before its time, null without one."""
    a = left.select("*", F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias(value))
    b = right.select(*(F.lit(None).cast(f.dataType).alias(f.name) if f.name not in (*key, at) else F.col(f.name) for f in left.schema), F.lit(0).alias("_side"), value)
    w = Window.partitionBy(*key).orderBy(at, "_side", value)
    both = a.unionByName(b).withColumn("_value", F.last(value, ignorenulls=True).over(w))
    return both.where("_side = 1").drop("_side", value).withColumnRenamed("_value", value)


def shift_boundaries(rows: DataFrame, key: Sequence[str], order: str, new_end: Column) -> DataFrame:
    """Each interval ends at its new boundary and begins at the one before."""
    w = Window.partitionBy(*key).orderBy(order)
    return rows.withColumn("_end", new_end).select(
        *key, order, F.coalesce(F.lag("_end").over(w), F.col("begin")).alias("begin"), F.col("_end").alias("end")
    )


def frame_index(begin: Column, origin: Column, frame: int = 10_000) -> Column:
    """Number of the frame (10 ms) at a time, counted from the origin."""
    return F.floor((begin - origin) / frame)


def clip(end: Column, limit: Column) -> Column:
    return F.least(end, limit)


def decibel(power: Column) -> Column:
    return 10 * F.log10(F.greatest(power, F.lit(2.220446049250313e-16)))


def _pieces(rows: DataFrame, made: Column, share: float) -> DataFrame:
    """rows cut into a piece for each label of ``made``: of equal length, or at ``share`` of it where there are two."""
    rest = [c for c in rows.columns if c not in ("begin", "end", "label")]
    cut = rows.withColumn("_made", made).select(*rest, "begin", "end", F.size("_made").alias("_n"), F.posexplode("_made").alias("_j", "label"))
    length = F.col("end") - F.col("begin")
    at = lambda j: F.when((F.col("_n") == 2) & (j == 1), F.col("begin") + F.floor(length * share)).otherwise(
        F.col("begin") + F.floor(length * j / F.col("_n"))
    )
    return cut.select(*rest, at(F.col("_j")).alias("begin"), at(F.col("_j") + 1).alias("end"), "label", F.col("_j").alias("piece"))


def split_labels(rows: DataFrame, mapping: dict[str, list[str]], share: float = 0.5) -> DataFrame:
    """Intervals whose label maps to several labels, cut into pieces (two of them at ``share``); others stay."""
    table = F.create_map(*(x for k, v in mapping.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return _pieces(rows, F.coalesce(F.try_element_at(table, F.col("label")), F.array("label")), share)


def remap_labels(rows: DataFrame, key: Sequence[str], order: Sequence[str], mapping: dict[str, list[str]], share: float = 0.5) -> DataFrame:
    """Intervals of each key in order with other labels; a key of ``mapping`` is a label or several in a row, parted by spaces.

    From the left, the longest sequence of labels that the mapping has becomes one interval from the first one's begin to the last
    one's end, and that is cut into a piece for each new label (see split_labels). Other columns are those of the first interval.
    Labels without an entry stay, null labels match nothing, and sequences don't go over the end of a key. ``piece`` numbers the pieces.

    The rows are numbered in range partitions, so a hot key spreads. Each row meets the few after it by number, and
    where matches overlap, those that a walk from the left would take are found by doubling jumps: as many rounds as the logarithm of the
    longest chain of overlapping matches, over the overlapping rows alone.
    """
    join = lambda labels: "\x1f".join(labels)
    longest = max((len(k.split()) for k in mapping), default=1)
    table = F.create_map(*(x for k, v in mapping.items() for x in (F.lit(join(k.split())), F.array(*map(F.lit, v))))) if mapping else None
    if table is None or longest == 1:
        return split_labels(rows, mapping, share) if mapping else rows.withColumn("piece", F.lit(0))
    ids = dense_ids(rows, *key, *order, name="_at")
    near = ids.select(F.explode(F.sequence(F.lit(0), F.lit(longest - 1))).alias("_k"), "_at", F.struct(*key).alias("_key"), "label", "end")
    near = near.groupBy((F.col("_at") - F.col("_k")).alias("_at")).agg(F.sort_array(F.collect_list(F.struct("_k", "_key", "label", "end"))).alias("_s"))
    found = []
    for k in range(longest, 0, -1):
        last = F.get("_s", k - 1)
        whole = (F.size("_s") >= k) & last["_key"].eqNullSafe(F.get("_s", 0)["_key"])
        known = F.forall(F.slice("_s", 1, k), lambda x: x["label"].isNotNull())
        made = F.try_element_at(table, F.array_join(F.transform(F.slice("_s", 1, k), lambda x: x["label"]), "\x1f"))
        found.append(F.when(whole & known & made.isNotNull(), F.struct(F.lit(k).alias("length"), made.alias("made"), last["end"].alias("until"))))
    match = near.where(F.col("_at") >= 0).select("_at", F.coalesce(*found).alias("_m")).where("_m IS NOT NULL").checkpoint()

    long = match.where("_m.length > 1").select("_at", F.col("_m.length").alias("length"))
    covered = long.select(F.explode(F.sequence(F.col("_at") + 1, F.col("_at") + F.col("length") - 1)).alias("_at")).distinct().checkpoint()
    lengths = covered.join(long, "_at", "left").select("_at", F.coalesce("length", F.lit(1)).alias("length"))
    inside = covered.withColumnRenamed("_at", "to")
    jumps = lambda x: x.select("_at", (F.col("_at") + F.col("length")).alias("to")).join(inside, "to", "left_semi").select("_at", "to")
    taken = jumps(long.join(covered, "_at", "left_anti")).select(F.col("to").alias("_at")).distinct().checkpoint()
    jump = jumps(lengths).checkpoint()
    while not jump.isEmpty():
        taken = taken.unionByName(jump.join(taken, "_at", "left_semi").select(F.col("to").alias("_at"))).distinct().checkpoint()
        second = jump.select(F.col("_at").alias("to"), F.col("to").alias("_to"))
        jump = jump.join(second, "to").select("_at", F.col("_to").alias("to")).checkpoint()

    passed = covered.join(taken, "_at", "left_anti")
    kept = ids.join(passed, "_at", "left_anti").join(match, "_at", "left")
    kept = kept.withColumn("end", F.coalesce("_m.until", "end"))
    made = F.coalesce("_m.made", F.array("label"))
    return _pieces(kept, made, share).select(*rows.columns, "piece")


def merge_equal_labels(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Runs of neighbours with one label as one interval: key, label, begin, end, n."""
    w = Window.partitionBy(*key).orderBy(*order)
    fresh = F.when(F.col("label").eqNullSafe(F.lag("label").over(w)), 0).otherwise(1)
    marked = rows.withColumn("_fresh", fresh).withColumn("_run", F.sum("_fresh").over(w))
    return marked.groupBy(*key, "_run", "label").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.count("*").alias("n")).drop("_run")
