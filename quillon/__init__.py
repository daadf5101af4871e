"""quillon: a PySpark-native analytics engine for evaluation and experiment data.

Every operator takes DataFrames (or Columns) and returns DataFrames (or
Columns); Catalyst and AQE choose the physical plan.
"""

from quillon.session import session

__all__ = ["session"]
