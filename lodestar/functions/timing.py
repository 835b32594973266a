"""Elapsed times of a driver program."""

from __future__ import annotations

import time


class Timer:
    """Keeps named check points."""

    def __init__(self):
        self.points: list[tuple[str, float]] = []

    def check(self, name: str) -> float:
        self.points.append((name, time.perf_counter()))
        return self.interval()

    def interval(self) -> float:
        """Seconds between the last two check points."""
        return self.points[-1][1] - self.points[-2][1] if len(self.points) > 1 else 0.0

    def elapsed(self) -> float:
        return self.points[-1][1] - self.points[0][1] if self.points else 0.0

    def shown(self) -> str:
        whole = int(self.elapsed())
        return f"{whole // 60}m {whole % 60}s ({whole})s"
