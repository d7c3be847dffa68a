"""Independent DuckDB SQL for the correctness gate.

``domain.CTES`` re-states the adapter rules as SQL over the driver views;
``queries.ORACLE`` holds one SQL text per registered query.  Nothing here
imports Spark code; only the constraint metadata lists are shared.
"""
