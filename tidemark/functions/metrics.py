"""Counters, gauges and histograms of a store, and their Prometheus text."""

from __future__ import annotations

import threading
from collections import defaultdict

# Upper bounds of the histograms' buckets.
LATENCY_US = (100, 500, 1000, 2000, 5000, 10000, 50000, 100000)
RATIO = (0.1, 0.25, 0.5, 0.75, 1.0)

#: Name, kind and meaning of every metric that carries a table.
BY_TABLE = (
    ("feature_append_total", "counter", "Frames appended"),
    ("feature_append_bytes_total", "counter", "Bytes appended"),
    ("feature_get_total", "counter", "Lookups that found a frame"),
    ("feature_get_miss_total", "counter", "Lookups that found none"),
    ("batch_get_total", "counter", "Batch lookups"),
    ("batch_get_keys_total", "counter", "Keys of batch lookups"),
    ("crc_error_total", "counter", "Frames with a wrong checksum"),
    ("ttl_expired_frames_total", "counter", "Frames that compaction dropped for their age"),
    ("ttl_expired_keys_total", "counter", "Entities that compaction left without a frame"),
)
GAUGES = (("active_tables", "Tables that exist"), ("dropped_tables_total", "Tables dropped"), ("pinned_buffers", "Buffers pinned"))
HISTOGRAMS = (("append_latency_us", LATENCY_US), ("get_latency_us", LATENCY_US), ("batch_get_latency_us", LATENCY_US), ("projection_ratio", RATIO))
#: Of an embedded storage engine; always 0 here.
PASSED_THROUGH = ("block_cache_hit", "block_cache_miss", "compaction_pending_bytes", "memtable_bytes")


class Histogram:
    """Cumulative buckets: ``counts[i]`` values were at most ``bounds[i]``."""

    def __init__(self, bounds: tuple[float, ...]) -> None:
        self.bounds, self.counts, self.total, self.sum = bounds, [0] * len(bounds), 0, 0.0

    def observe(self, value: float) -> None:
        self.total += 1
        self.sum += value
        for i, bound in enumerate(self.bounds):
            self.counts[i] += value <= bound


class Metrics:
    """One store's metrics; safe for use from several threads."""

    def __init__(self) -> None:
        self._lock = threading.Lock()
        self.counters: dict[tuple[str, int], int] = defaultdict(int)
        self.gauges: dict[str, int] = defaultdict(int)
        self.histograms = {name: Histogram(bounds) for name, bounds in HISTOGRAMS}

    def add(self, name: str, table: int, n: int = 1) -> None:
        with self._lock:
            self.counters[name, table] += n

    def move(self, name: str, n: int) -> None:
        """Change a gauge; it doesn't fall below 0."""
        with self._lock:
            self.gauges[name] = max(0, self.gauges[name] + n)

    def set(self, name: str, n: int) -> None:
        with self._lock:
            self.gauges[name] = n

    def observe(self, name: str, value: float) -> None:
        with self._lock:
            self.histograms[name].observe(value)

    def text(self) -> str:
        with self._lock:
            lines = []
            tables = sorted({t for _, t in self.counters})
            for name, kind, meaning in BY_TABLE:
                lines += [f"# HELP {name} {meaning}", f"# TYPE {name} {kind}"]
                lines += [f'{name}{{table="{t}"}} {self.counters.get((name, t), 0)}' for t in tables] or [f"{name} 0"]
            for name, meaning in GAUGES:
                lines += [f"# HELP {name} {meaning}", f"# TYPE {name} gauge", f"{name} {self.gauges[name]}"]
            for name, histogram in self.histograms.items():
                lines += [f"# TYPE {name} histogram"]
                lines += [f'{name}_bucket{{le="{bound}"}} {n}' for bound, n in zip(histogram.bounds, histogram.counts, strict=True)]
                lines += [f'{name}_bucket{{le="+Inf"}} {histogram.total}', f"{name}_sum {histogram.sum}", f"{name}_count {histogram.total}"]
            lines += [x for name in PASSED_THROUGH for x in (f"# TYPE {name} gauge", f"{name} 0")]
            return "\n".join(lines) + "\n"


def histogram_frame(rows, column: str, bounds: tuple[float, ...]):
    """``le``, ``n``: cumulative counts of a column, in one aggregate over the rows."""
    from pyspark.sql import functions as F

    counts = rows.agg(*(F.sum(F.when(F.col(column) <= b, 1).otherwise(0)).cast("long").alias(f"b{i}") for i, b in enumerate(bounds)))
    pairs = ", ".join(f"cast({b} as double), coalesce(b{i}, 0)" for i, b in enumerate(bounds))
    return counts.selectExpr(f"stack({len(bounds)}, {pairs}) as (le, n)")
