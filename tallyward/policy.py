"""Lateness rules and the other values that results depend on."""

from dataclasses import dataclass

# They decide the results, so they are stated as they are.
WINDOW_MINUTES = 15
WATERMARK_DELAY_MINUTES = 2
ALLOWED_LATENESS_MINUTES = 10
BATCH_SIZE = 500
LATE_EXAMPLES = 5

ZONES = ["downtown", "airport", "university", "waterfront", "harbor_north", "harbor_tunnel"]
HARBOR_ZONES = ["harbor_north", "harbor_tunnel"]

COMPLETENESS_THRESHOLD = 0.97
BUSY_WINDOWS = 8
WORST_WINDOWS = 8
SAMPLE_ROWS = 4

NORMAL_DELAY_SECONDS = (1, 5)
TUNNEL_DELAY_SECONDS = (120, 480)
VERY_LATE_DELAY_SECONDS = (1200, 3600)
NEXT_MORNING_HOURS = (6, 9)

CORRECTION_JOB = "rebuild-day-from-late"

# Micro-batches of a backlog that are worked on together.
BATCHES_PER_TRIGGER = 1000

# Copies of one row that a task writes at a time.
COPIES_PER_STEP = 10_000


@dataclass(frozen=True)
class LatenessPolicy:
    """When a tumbling window is final, in minutes of event time."""

    window_minutes: int = WINDOW_MINUTES
    watermark_delay_minutes: int = WATERMARK_DELAY_MINUTES
    allowed_lateness_minutes: int = ALLOWED_LATENESS_MINUTES

    @property
    def closes_after(self) -> int:
        """Minutes past its start at which the watermark closes a window."""
        return self.window_minutes + self.allowed_lateness_minutes

    @property
    def final_after(self) -> int:
        """Minutes past its start at which a newly seen event time closes a window."""
        return self.closes_after + self.watermark_delay_minutes
