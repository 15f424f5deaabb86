"""Multi-channel biosignal analytics as Spark DataFrame operators."""

from sinew.session import build_session, prepare, settle

__all__ = ["build_session", "prepare", "settle"]
__version__ = "0.1.0"
