"""Live figures of a running stream, from Spark's own progress events."""

from collections.abc import Callable

from pyspark.sql.streaming import StreamingQueryListener

#: Name of the figures that the stream observes on the entries of a trigger.
LANDED = "landed"


class LiveFigures(StreamingQueryListener):
    """Per trigger: its number (that of its batch, unless triggers have several), files and rows admitted, arrival range,
    and how long it took.

    Register it with spark.streams.addListener. `seen` keeps the newest figures, at most `keep`, and `tell` is
    called with each. Nothing is read again for them.
    """

    def __init__(self, tell: Callable[[dict], None] | None = None, keep: int = 1000):
        self.seen: list[dict] = []
        self.tell = tell or (lambda figures: None)
        self.keep = keep

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        landed = event.progress.observedMetrics.get(LANDED)
        if landed is None or not landed.files:
            return
        figures = {"batch_id": event.progress.batchId + 1, **landed.asDict(), "millis": event.progress.batchDuration}
        self.seen = [*self.seen, figures][-self.keep :]
        self.tell(figures)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
