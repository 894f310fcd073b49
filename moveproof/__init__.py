"""moveproof: prove that a table migration is complete and clean, on Spark."""

from moveproof.session import build_session, scratch_dir, table, tables

__all__ = ["build_session", "scratch_dir", "table", "tables"]
