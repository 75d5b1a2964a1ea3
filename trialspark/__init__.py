"""trialspark: trial-log cleaning, signal similarity and within-subject statistics on Spark.

Every operator takes and returns DataFrames and is expressed with built-in
DataFrame functions, windows and aggregates; grouped pandas functions are used
only where an array transform or a small per-group solve needs them.
"""

from trialspark.session import checkpoint_dir, get_spark

__all__ = ["get_spark", "checkpoint_dir"]
