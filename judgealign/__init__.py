"""judgealign: measure how well automatic judges agree with human annotators, on Spark.

Every public operator takes DataFrames (or Columns) and returns DataFrames (or Columns).
The canonical shapes are

* ratings      ``(item_id, dim, annotator, raw)``
* predictions  ``(item_id, trial, <one column per dimension>)``
* pairs        ``(item_id, dim, pred, truth, ...)``
"""

from judgealign.session import build_session

__all__ = ["build_session"]
