"""quarry: literature retrieval on Spark.

Build a text + vector corpus, search it exactly or approximately, score it with
BM25, fuse rankings, feed back relevance labels and measure recall, all as
DataFrame / SQL / Spark ML / Structured Streaming jobs.
"""

import sys as _sys

# Functions of this package that run inside Python workers (block scoring,
# encoders, pair scorers) are shipped with the task by value, so executors do
# not need the package installed or on their path.
try:
    from pyspark import cloudpickle as _cloudpickle
    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001 - older cloudpickle: fall back to --py-files / installed package
    pass

from quarry.session import build_session, checkpoint_dir  # noqa: E402

__all__ = ["build_session", "checkpoint_dir"]
