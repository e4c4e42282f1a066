"""The parameters every report shares: period, outage, privacy and exchange rate."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

# Fixed values of the study.
IDR_PER_USD = 14150
K_ANONYMITY = 5
BYTES_PER_MB = 1_000_000
BYTES_PER_GB = 1_000_000_000
SECONDS_PER_DAY = 86400


@dataclass(frozen=True)
class StudyWindow:
    """Half-open study period [lo, hi) with one half-open outage in it."""

    lo: dt.datetime = dt.datetime(2019, 3, 10)
    hi: dt.datetime = dt.datetime(2019, 3, 10) + dt.timedelta(weeks=53)
    outage_lo: dt.datetime = dt.datetime(2019, 7, 30)
    outage_hi: dt.datetime = dt.datetime(2019, 9, 1)

    @property
    def days(self) -> float:
        return (self.hi - self.lo).total_seconds() / SECONDS_PER_DAY
