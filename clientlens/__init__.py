"""clientlens: a PySpark-native "Client 360" analytics library.

Layout
------
* ``sources``   — raw-file readers (CSV, fixed width, Parquet, JSON, XML,
  NDJSON, workbooks), the driver test-data loader, source inventory, sinks.
* ``functions`` — Column-level helpers (strings, dates, numerics, vectors).
* ``operators`` — DataFrame-in / DataFrame-out analytics: canonical mapping,
  key drivers, graph paths, vector search, embeddings, forecasting, anomaly
  detection, features, segmentation, attrition, entity resolution.
* ``plans``     — end-to-end read models composed from the operators.
* ``streaming`` — Structured Streaming variants of the transaction monitors.
"""

__version__ = "0.1.0"
