"""Codebase and change-history analytics on Apache Spark."""

from lodestrata.session import build_session, checkpointed

__all__ = ["build_session", "checkpointed"]
