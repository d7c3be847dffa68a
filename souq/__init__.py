"""souq: merchant analytics on Spark.

Every operator is a function from DataFrames (plus plain parameters) to a
DataFrame built from built-in Spark expressions, so Catalyst can prune,
push down and plan it.  Layout:

- ``sources``   readers, the domain adapter over the driver tables, sinks
- ``functions`` column-expression helpers (money, dates, statistics, text)
- ``plans``     warehouse build (dimensions, facts, upsert) and marts
- ``operators`` semantic layer, quality audits, dashboard, growth,
                experiments, features, machine learning
- ``streaming`` Structured Streaming jobs
"""

__version__ = "0.1.0"
