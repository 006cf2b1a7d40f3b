"""framelake: analytics over per-frame state data, built on Spark DataFrames."""

from framelake.session import build_session

__all__ = ["build_session"]
