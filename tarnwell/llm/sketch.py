"""Problem 2: percentiles of very large numeric columns, from mergeable sketches."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch

#: Values in a section of a compactor. With 64, the rank of a reported value is off by more than RANK_ERROR * (n - rank)
#: with a chance under 0.3 % (three standard deviations, sqrt(0.0512 / 3) / SECTION each).
SECTION = 64
RANK_ERROR = 0.0062
QUANTILES = (0.5, 0.9, 0.99)
#: Stands for a NULL group within a task.
NO_GROUP = "\x1eno group"
CHUNK_ROWS = 500_000
FAN_IN = 16
STATE = "series int, grp string, day int, level int, flips bigint, sections int, vals array<double>, n bigint"


class Compactors:
    """A relative-rank quantile sketch that protects the upper tail.

    Level h holds values of weight 2**h. A full level sorts itself and compacts its lowest values: every other one,
    from an odd or even start by a coin, moves up. How much is compacted follows the trailing ones of a counter, so
    the largest values of a level are hardly ever touched and the error in rank shrinks with the distance to the
    maximum. Two sketches merge level by level; the counters are joined by bits. Coins are drawn from a hash of the
    key, which names the task, the level and the counter: sketches that are merged toss their own, and a task that is
    run again gives the same result.
    """

    def __init__(self, key: str, section: int = SECTION):
        self.seed, self.section, self.n = zlib.crc32(key.encode()), section, 0
        self.levels: list[np.ndarray] = [np.empty(0)]
        self.flips: list[int] = [0]
        self.sections: list[int] = [3]

    def _capacity(self, h: int) -> int:
        return 2 * self.sections[h] * self._width(h)

    def _width(self, h: int) -> int:
        return max(4, 2 * round(self.section / math.sqrt(2 ** math.log2(self.sections[h] / 3)) / 2))

    def update(self, values: np.ndarray) -> None:
        step = 4 * self._capacity(0)
        for i in range(0, len(values), step):  # as if they came one after the other
            part = values[i : i + step]
            self.n += len(part)
            self.levels[0] = np.concatenate([self.levels[0], part])
            self._compress()

    def _compress(self) -> None:
        h = 0
        while h < len(self.levels):
            while len(self.levels[h]) >= self._capacity(h):
                self._compact(h)
            h += 1

    def _compact(self, h: int) -> None:
        if h + 1 == len(self.levels):
            self.levels.append(np.empty(0))
            self.flips.append(0)
            self.sections.append(3)
        buf = np.sort(self.levels[h])
        ones = (~self.flips[h] & (self.flips[h] + 1)).bit_length() - 1  # trailing ones
        kept = self._capacity(h) // 2 + (self.sections[h] - min(ones + 1, self.sections[h])) * self._width(h)
        low = len(buf) - kept
        low -= low % 2
        low = max(low, 2)
        coin = zlib.crc32(f"{self.seed}:{h}:{self.flips[h]}:{self.n}".encode()) >> 7 & 1
        self.levels[h + 1] = np.concatenate([self.levels[h + 1], buf[coin:low:2]])
        self.levels[h] = buf[low:]
        self.flips[h] += 1
        if self.flips[h] >= 1 << (self.sections[h] - 1):
            self.sections[h] *= 2

    def merge_level(self, h: int, values: np.ndarray, flips: int, sections: int) -> None:
        while h >= len(self.levels):
            self.levels.append(np.empty(0))
            self.flips.append(0)
            self.sections.append(3)
        self.levels[h] = np.concatenate([self.levels[h], values])
        self.flips[h] |= flips
        self.sections[h] = max(self.sections[h], sections)
        self.n += len(values) << h

    def finish(self) -> Compactors:
        self._compress()
        return self

    def quantiles(self, qs: tuple[float, ...] = QUANTILES) -> list[float]:
        """The least kept value whose estimated rank is at least ceil(q * n)."""
        v = np.concatenate(self.levels)
        w = np.concatenate([np.full(len(x), 1 << h, np.int64) for h, x in enumerate(self.levels)])
        order = np.argsort(v, kind="stable")
        rank = np.cumsum(w[order])
        return [float(v[order][min(np.searchsorted(rank, max(1, math.ceil(q * rank[-1] - 1e-9))), len(v) - 1)]) for q in qs]


def _key(series, grp, day) -> str:
    return f"{series}\x1f{grp}\x1f{day}"


def _state(series, grp, day, sketch: Compactors) -> list[tuple]:
    return [(series, grp, day, h, sketch.flips[h], sketch.sections[h], x, sketch.n if h == 0 else 0) for h, x in enumerate(sketch.levels)]


_NAMES = [c.split()[0] for c in STATE.split(", ")]


def _partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One sketch per series, group and day of this task's rows, built from chunks of at most CHUNK_ROWS."""
    sketches: dict[tuple, Compactors] = {}
    task = TaskContext.get().partitionId()

    def fold(chunk: list[pd.DataFrame]) -> None:
        rows = pd.concat(chunk, ignore_index=True)
        codes, keys = pd.factorize(pd.MultiIndex.from_arrays([rows["series"], rows["grp"].fillna(NO_GROUP), rows["day"].fillna(-(2**31))]))
        order = np.argsort(codes, kind="stable")
        values, codes = rows["value"].to_numpy(float)[order], codes[order]
        for part, start in zip(np.split(values, np.flatnonzero(np.diff(codes)) + 1), np.concatenate([[0], np.flatnonzero(np.diff(codes)) + 1])):
            key = keys[codes[start]]
            if key not in sketches:
                sketches[key] = Compactors(f"{_key(*key)}\x1f{task}")  # own coins in each task, or errors would add up
            sketches[key].update(part)

    held, n = [], 0
    for b in batches:
        if len(b):
            held.append(b)
            n += len(b)
        if n >= CHUNK_ROWS:
            fold(held)
            held, n = [], 0
    if held:
        fold(held)
    out = [row for (series, grp, day), s in sketches.items() for row in _state(series, None if grp == NO_GROUP else grp, None if day == -(2**31) else int(day), s)]
    for i in range(0, len(out), 2000):
        yield pd.DataFrame(out[i : i + 2000], columns=_NAMES).astype({"day": "Int32"})


#: States held of a key before they are merged.
PENDING = 256


def _absorb(sketch: Compactors, pending: list[tuple]) -> None:
    """Merges states in an order that doesn't depend on their arrival."""
    for level, flips, sections, vals in sorted(pending, key=lambda s: (s[0], len(s[3]), s[1], s[3][:4].tolist())):
        sketch.merge_level(level, vals, flips, sections)
    pending.clear()


def _merge_task(with_day: bool, report: bool):
    """A task's states merged by (series, grp, day), or by (series, grp): as states, or as percentiles."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sketches: dict[tuple, tuple[Compactors, list]] = {}
        task = TaskContext.get().partitionId()
        for b in batches:
            days = b["day"].astype("Int64").tolist() if with_day else [None] * len(b)
            for series, grp, day, level, flips, sections, vals in zip(b["series"], b["grp"], days, b["level"], b["flips"], b["sections"], b["vals"]):
                key = (int(series), grp if isinstance(grp, str) else None, None if day is None or day is pd.NA else int(day))
                if key not in sketches:
                    sketches[key] = (Compactors(f"{_key(*key)}\x1fmerged\x1f{task}"), [])
                sketch, pending = sketches[key]
                pending.append((int(level), int(flips), int(sections), np.asarray(vals, float)))
                if len(pending) >= PENDING:
                    _absorb(sketch, pending)
                    sketch.finish()
        out = []
        for (series, grp, day), (sketch, pending) in sketches.items():
            _absorb(sketch, pending)
            sketch.finish()
            if report:
                out.append((series, grp, day, sketch.n, *sketch.quantiles()))
            else:
                out += _state(series, grp, day, sketch)
        names = ["series", "grp", "day", "n", "p50", "p90", "p99"] if report else _NAMES
        for i in range(0, len(out), 2000):
            yield pd.DataFrame(out[i : i + 2000], columns=names).astype({"day": "Int32"})

    return run


_RESULT = "series int, grp string, day int, n bigint, p50 double, p90 double, p99 double"


def daily_sketches(values: DataFrame) -> DataFrame:
    """STATE of each (series, grp, day) of values (series, grp, day, value): what one keeps of a day.

    Tasks sketch their own rows; the sketches of a key then climb a tree in which a node takes those of FAN_IN tasks.
    """
    states = values.mapInPandas(_partial, STATE).withColumn("node", F.spark_partition_id())
    width = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while width > FAN_IN:
        width = -(-width // FAN_IN)
        node = F.floor(F.col("node") / FAN_IN).cast("int")
        states = states.repartition("series", "grp", "day", node).drop("node").mapInPandas(_merge_task(True, False), STATE).withColumn("node", F.pmod(F.spark_partition_id(), F.lit(width)))
    return states.drop("node").repartition("series", "grp", "day").mapInPandas(_merge_task(True, False), STATE)


def ledger_values(ddl_history: DataFrame, audit_log: DataFrame) -> DataFrame:
    """(series, grp, day, value): durations by environment (0) and affected rows by tool (1), each id once.

    Replays are identical in sound data; of rows that differ the least (group, day, value) counts. Rows without id
    are left out, as are NULL values and negative ones, which neither a duration nor a count of rows can have.
    """
    a = ddl_history.select(F.lit(0).alias("series"), "id", F.col("environment").alias("grp"), F.unix_date(F.col("applied_at").cast("date")).alias("day"), F.col("duration_ms").cast("double").alias("value"))
    b = audit_log.select(F.lit(1).alias("series"), "id", F.col("tool").alias("grp"), F.unix_date(F.col("ts").cast("date")).alias("day"), F.col("rows_affected").cast("double").alias("value"))
    once = a.unionByName(b).where(F.col("id").isNotNull()).groupBy("series", "id").agg(F.min(F.struct("grp", "day", "value")).alias("x"))
    return once.select("series", "x.*").where(F.col("value") >= 0)


def percentiles(ddl_history: DataFrame, audit_log: DataFrame) -> DataFrame:
    """(source_table, metric, grp, period, day, n, p50, p90, p99, rank_error) per day and overall.

    Each percentile is a value of the data whose rank is off by at most rank_error * (n - rank), as RANK_ERROR
    states; while a sketch is not full it is exact. Overall values (period all, day NULL) come from the daily
    sketches alone. NULL groups and days are groups and days of their own; tables without values give no rows.
    """
    daily = Scratch(ddl_history.sparkSession, "sketches").save(daily_sketches(ledger_values(ddl_history, audit_log)), "daily")
    per_day = daily.repartition("series", "grp", "day").mapInPandas(_merge_task(True, True), _RESULT).withColumn("period", F.lit("day"))
    overall = daily.repartition("series", "grp").mapInPandas(_merge_task(False, True), _RESULT).withColumn("period", F.lit("all"))
    r = per_day.unionByName(overall)
    first = F.col("series") == 0
    return r.select(
        F.when(first, "ddl_history").otherwise("audit_log").alias("source_table"),
        F.when(first, "duration_ms").otherwise("rows_affected").alias("metric"),
        "grp", "period", F.date_from_unix_date("day").cast("string").alias("day"), "n", "p50", "p90", "p99", F.lit(RANK_ERROR).alias("rank_error"),
    )
