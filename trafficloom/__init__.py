"""trafficloom: access-log analytics for forward proxies, built on PySpark.

Every operator is a function from DataFrames (plus plain parameters) to a
DataFrame. Nothing runs until the caller triggers an action, except where a
docstring says that a size check or a write happens.
"""

from trafficloom.session import build_session

__all__ = ["build_session"]
