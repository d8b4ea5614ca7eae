"""Nested regions of a driver program with wall time, CPU time and resident memory, as rows."""

from __future__ import annotations

import contextlib
import threading
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "phase string, depth int, status string, wall_ns long, cpu_ns long, rss_start long, rss_end long, rss_peak long"


def resident() -> int:
    """Bytes of this process's resident memory; 0 where the system does not tell."""
    with contextlib.suppress(OSError, ValueError):
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096
    return 0


class Profiler:
    """Records regions. Ends without a start are kept as diagnostics; a sampler thread runs while any region is open."""

    def __init__(self, interval: float = 0.005):
        self.rows: list[tuple] = []
        self.diagnostics: list[str] = []
        self._open: list[list] = []
        self._interval, self._thread = interval, None
        self._lock = threading.Lock()

    def start(self, phase: str) -> None:
        now = resident()
        with self._lock:
            self._open.append([phase, time.perf_counter_ns(), time.process_time_ns(), now, now])
        if self._thread is None or not self._thread.is_alive():
            self._thread = threading.Thread(target=self._sample, daemon=True)
            self._thread.start()

    def _sample(self) -> None:
        while self._open:
            now = resident()
            with self._lock:
                for r in self._open:
                    r[4] = max(r[4], now)
            time.sleep(self._interval)

    def end(self, phase: str, status: str = "ok") -> None:
        """Ends the innermost region of that name; regions within it that are still open end with it as failed."""
        with self._lock:
            if phase not in [r[0] for r in self._open]:
                self.diagnostics.append(f"end of {phase} without a start")
                return
            while True:
                name, wall, cpu, low, peak = self._open.pop()
                mine, now = name == phase, resident()
                if not mine:
                    self.diagnostics.append(f"{name} was still open at the end of {phase}")
                self.rows.append((name, len(self._open), status if mine else "failed", time.perf_counter_ns() - wall, time.process_time_ns() - cpu, low, now, max(peak, now)))
                if mine:
                    return

    @contextlib.contextmanager
    def region(self, phase: str) -> Iterator[None]:
        self.start(phase)
        try:
            yield
        except BaseException:
            self.end(phase, "failed")
            raise
        self.end(phase)

    def records(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, SCHEMA)
