"""casalith: a PySpark-native engine for evidence-centred analytics.

Every operator takes and returns DataFrames; nothing here keeps state outside Spark.
"""

__version__ = "0.1.0"
