"""Spark-native labelling of scientific documents.

Every function takes DataFrames and returns DataFrames; the sub-packages follow
the life of a corpus: ``sources`` -> ``functions`` / ``operators`` -> ``plans``,
with ``streaming`` for incremental ingestion and labelling.
"""

__version__ = "0.1.0"
