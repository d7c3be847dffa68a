"""Governed metrics (L1-L8): a catalogue of metric contracts compiled to
``groupBy(...).agg(expr)``.

The formula is applied with ``F.expr`` to a DataFrame, never pasted into
SQL text, and the group column is validated against the source schema
(the reference interpolates both into a SQL string, Q7).
"""

from __future__ import annotations

import os
from dataclasses import dataclass
from functools import reduce

import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Metric:
    name: str
    label: str
    owner: str
    description: str
    sql_formula: str          # the contract's formula as published
    data_source: str
    type: str
    currency: str | None = None
    spark_formula: str | None = None   # same meaning, engine-safe

    @property
    def formula(self) -> str:
        return self.spark_formula or self.sql_formula


CONTRACTS = os.path.join(os.path.dirname(__file__), "metrics.yaml")


def load_catalog(path: str = CONTRACTS) -> dict[str, Metric]:
    """L1: the metric contracts of a YAML file, by name; a missing file is an empty catalogue.

    The file holds a list ``metrics`` of mappings with the fields of
    :class:`Metric`; an unknown or missing field is an error.
    """
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        entries = (yaml.safe_load(f) or {}).get("metrics") or []
    return {m.name: m for m in (Metric(**e) for e in entries)}


CATALOG = load_catalog()


def metric_catalog(catalog: dict[str, Metric] | None = None) -> dict[str, Metric]:
    """L1: name -> contract.  A missing catalogue is an empty one."""
    return dict(CATALOG if catalog is None else catalog)


def get_metric(name: str, catalog: dict[str, Metric] | None = None) -> Metric:
    cat = metric_catalog(catalog)
    if name not in cat:
        raise ValueError(f"Metric '{name}' is not defined in the semantic layer catalog.")
    return cat[name]


def compile_metric(sources: dict[str, DataFrame], name: str, group_by: str = "store_id",
                   catalog: dict[str, Metric] | None = None) -> DataFrame:
    """L2: (metric, group column) -> one row per group with the metric."""
    m = get_metric(name, catalog)
    if m.data_source not in sources:
        raise ValueError(f"data source {m.data_source!r} of metric {name!r} is not available")
    src = sources[m.data_source]
    if group_by not in src.columns:
        raise ValueError(f"column {group_by!r} does not exist in {m.data_source} (metric {name!r})")
    return src.groupBy(group_by).agg(F.expr(m.formula).alias(m.name))


def metric_query_api(sources: dict[str, DataFrame], name: str, n: int = 10) -> DataFrame:
    """The metric by store, first ``n`` stores by id (ordered, Q15)."""
    return compile_metric(sources, name, "store_id").orderBy("store_id").limit(n)


def metric_catalog_values(sources: dict[str, DataFrame], catalog: dict[str, Metric] | None = None) -> DataFrame:
    """L1 as a query: every contract of the catalogue with its platform-wide
    value, in one aggregate per source table."""
    by_source: dict[str, list[Metric]] = {}
    for m in metric_catalog(catalog).values():
        by_source.setdefault(m.data_source, []).append(m)
    parts = []
    for source, ms in by_source.items():
        one = sources[source].agg(*[F.expr(m.formula).cast("double").alias(f"v{i}") for i, m in enumerate(ms)])
        rows = F.array(*[F.struct(F.lit(m.name).alias("metric_name"), F.lit(m.label).alias("label"),
                                  F.lit(m.owner).alias("owner"), F.lit(m.type).alias("metric_type"),
                                  F.lit(source).alias("data_source"), F.col(f"v{i}").alias("value"))
                         for i, m in enumerate(ms)])
        parts.append(one.select(F.inline(rows)))
    return reduce(DataFrame.unionByName, parts)
