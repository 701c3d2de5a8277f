"""mathtide: maths word-problem corpus preparation and answer evaluation on Spark.

Every public operator takes DataFrames / Columns plus column names and returns a
DataFrame / Column.  The heavy lifting is built-in Spark expressions so that plans
stay inside whole-stage codegen; Python runs only where a user hands over foreign
code (a generator, an encoder) and then through Arrow batches.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions of this package that run inside Python workers (batch functions,
# per-slice ranking) are shipped with the task by value, so executors need no
# copy of the package on their path.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

from mathtide.session import checkpoint_dir, get_session, scratch_path  # noqa: E402

__all__ = ["get_session", "checkpoint_dir", "scratch_path"]
