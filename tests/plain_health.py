"""The breaker and pause rules as a plain loop, to check the set-based columns against."""

from __future__ import annotations

from dataclasses import dataclass

from shelfwatch.functions import fixed_values as V
from shelfwatch.operators.health import BreakerPolicy


@dataclass
class SourceHealth:
    run_failures: int = 0
    opens: int = 0
    streak: int = 0
    total_failures: int = 0
    breaker: str = "closed"
    open_until_us: int | None = None
    paused: bool = False

    def step(self, outcome: str, ts_us: int, policy: BreakerPolicy) -> bool:
        """Take one attempt; true when it opened the breaker. Same rules as the batch columns."""
        opened = False
        if outcome in ("ok", "resume"):
            self.run_failures, self.streak, self.breaker, self.open_until_us = 0, 0, "closed", None
            if outcome == "resume":
                self.total_failures, self.paused = 0, False
        elif outcome in V.ANOMALIES or outcome == "breaker_open":
            self.streak += 1
            self.total_failures += 1
            if outcome != "breaker_open":
                instant = outcome in V.INSTANT_OPEN_ANOMALIES
                self.run_failures += policy.failure_threshold if instant else 1
                opened = self.run_failures >= policy.failure_threshold
        elif outcome in ("throttled", "quota_exceeded", "dedup") and self.breaker == "open":
            self.breaker, self.open_until_us = "half_open", None
        if opened:
            self.opens += 1
            grown = policy.open_seconds * policy.backoff_factor ** min(self.opens - 1, 1000)
            self.breaker = "open"
            self.open_until_us = ts_us + int(min(grown, policy.max_open_seconds) * 1e6)
        many = self.opens >= policy.pause_after_opens or self.streak >= policy.pause_after_failures
        if outcome == "quota_exceeded" or ((opened or outcome == "breaker_open") and many):
            self.paused = True
        return opened
