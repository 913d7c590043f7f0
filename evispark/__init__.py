"""Evidence-integration operators on Spark DataFrames."""

from evispark.session import build_session

__all__ = ["build_session"]
