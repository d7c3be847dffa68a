"""Lazy star schema over a :class:`~souq.sources.adapter.Domain`."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame

from ..sources.adapter import Domain
from . import warehouse as W


class Star:
    def __init__(self, domain: Domain):
        self.d = domain

    @property
    def as_of(self):
        return self.d.as_of

    @cached_property
    def dim_merchant(self) -> DataFrame:
        return W.dim_merchant(self.d.merchants, self.d.regions)

    @cached_property
    def dim_store(self) -> DataFrame:
        return W.dim_store(self.d.stores)

    @cached_property
    def dim_customer(self) -> DataFrame:
        return W.dim_customer(self.d.customers, self.d.regions)

    @cached_property
    def dim_product(self) -> DataFrame:
        return W.dim_product(self.d.products, self.d.categories, self.d.inventory)

    @cached_property
    def dim_date(self) -> DataFrame:
        """Whole years around the first and last order; the horizon is derived inside the plan."""
        return W.dim_date_for(self.d.orders)

    @cached_property
    def fact_sales(self) -> DataFrame:
        return W.fact_sales(self.d.order_items, self.d.orders, self.d.products)

    @cached_property
    def fact_orders(self) -> DataFrame:
        return W.fact_orders(self.d.orders, self.d.payments, self.d.shipments)

    @cached_property
    def order_wide(self) -> DataFrame:
        return W.order_wide(self.fact_orders, self.dim_store, self.dim_merchant)

    def tables(self) -> dict[str, DataFrame]:
        """Warehouse tables by their reference names (semantic-layer sources)."""
        return {
            "dw_dim_merchant": self.dim_merchant,
            "dw_dim_store": self.dim_store,
            "dw_dim_customer": self.dim_customer,
            "dw_dim_product": self.dim_product,
            "dw_fact_sales": self.fact_sales,
            "dw_fact_orders": self.fact_orders,
            "dim_date": self.dim_date,
        }

    def tables_by_order(self, parts: int) -> dict[str, DataFrame]:
        """The same tables, with the lines of the sales dealt out by order into ``parts`` parts."""
        return self.tables() | {"dw_fact_sales": W.fact_sales(self.d.order_items_dealt(parts), self.d.orders, self.d.products)}
