"""Settings shared by every report.

``as_of`` replaces the wall clock so that a report gives the same rows each
time it runs; ``None`` means "now".
"""

from __future__ import annotations

import time
from dataclasses import dataclass, replace

# Fixed value: 2024-04-01 00:00 in Bogota, the first day of the traffic report.
HISTORY_FLOOR_EPOCH = 1711947600


@dataclass(frozen=True)
class Settings:
    report_tz: str = "America/Bogota"
    as_of: int | None = None
    floor_epoch: int = HISTORY_FLOOR_EPOCH
    # Label of the installation, printed in the users-by-environment report.
    environment: str = "LMS"
    # Label of the environment column of the traffic report.
    traffic_environment: str = "Producción"
    # User filter text is matched literally unless this is set, in which case
    # % and _ keep their LIKE meaning.
    raw_patterns: bool = False
    # Width of the time slices that keep one user-course pair from filling a task.
    gap_slice_seconds: int = 3600

    def now(self) -> int:
        return int(time.time()) if self.as_of is None else self.as_of

    def with_(self, **changes) -> "Settings":
        return replace(self, **changes)
