"""medlake: Spark-native operators for chronic-disease risk analytics.

Modules: ``sources`` (readers, derived tables, sinks), ``functions``
(column expressions), ``operators`` (table jobs), ``plans`` (registered
queries), ``streaming`` (Structured Streaming forms), ``session``.
"""

__version__ = "0.1.0"
