"""marginalia: a Spark-native engine that keeps a derived document index over relational tables correct.

Layers: ``functions`` (column expressions), ``sources`` (tables, snapshot
store), ``plans`` (render, reconcile, embed, search, drift, invalidate),
``operators`` (large-scale data operators), ``streaming`` (change feeds) and,
optionally, the subpackage ``llm``, which nothing else here imports.
"""

__version__ = "0.1.0"
