"""gridloom: a Spark-first engine for tiled object-detection data.

Every operator maps DataFrames to DataFrames with explicit key columns, so one plan covers many folds, models and thresholds.
"""

__version__ = "0.1.0"
