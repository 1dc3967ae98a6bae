"""Plumbline: data quality, profiling, cleaning, anomaly and AutoML on Spark.

Every operator takes a DataFrame (or a ``TableStats`` made from one, to share
passes between operators) and returns a DataFrame.
"""

from plumbline.plans.stats import TableStats, stats_of

__all__ = ["TableStats", "stats_of"]
