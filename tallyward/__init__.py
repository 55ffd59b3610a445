"""Exact late-data-safe event counts on Spark."""

from tallyward.policy import LatenessPolicy
from tallyward.session import get_session, prepare
from tallyward.streaming.ingest import CountingStream
from tallyward.tables.changelog import ChangeLog

__all__ = ["ChangeLog", "CountingStream", "LatenessPolicy", "get_session", "prepare"]
