"""Inventory movement (X19): every sale and return with the stock it leaves.

The declared schema stores only today's stock.  Going back from it, the stock
after any movement is today's stock less the changes that came later, that is
opening stock plus a running sum of changes.  The running sum is segmented by
product and day (:func:`souq.functions.prefix.running_sum`), so a product that
has a third of all lines is not ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import date_from_key
from ..functions.prefix import running_sum
from ..sources.sinks import written_once

#: states of a return whose goods are back in stock
RESTOCKED = ("Approved", "Refunded")


def _cents(c: str) -> Column:
    return (F.col(c) * 100).cast("long")


def movements(fact_sales: DataFrame, returns: DataFrame) -> DataFrame:
    """product_id, moved_on, kind (sale or return), ref_id, change in units.

    A sale takes its units out.  A return of a product of an order brings back
    as many units as its refund pays for at the order's mean price of that
    product, rounded half up; only returns in a state of ``RESTOCKED`` count,
    and one whose order has no such line brings nothing.
    """
    sales = fact_sales.select("product_id", date_from_key("date_id").alias("moved_on"), F.lit("sale").alias("kind"),
                              F.col("order_item_id").alias("ref_id"), (-F.col("quantity")).cast("long").alias("change"))
    bought = fact_sales.groupBy("order_id", "product_id").agg(
        F.sum("quantity").cast("long").alias("units"), F.sum(_cents("gross_sales")).alias("paid"))
    back = returns.where(F.col("return_status").isin(*RESTOCKED)).join(bought, ["order_id", "product_id"])
    # floor(refund * units / paid + 1/2) in whole numbers
    units = F.floor((2 * _cents("refund_amount") * F.col("units") + F.col("paid")).cast("decimal(38,0)") / (2 * F.nullif(F.col("paid"), F.lit(0))))
    return sales.union(back.select("product_id", F.to_date("requested_at").alias("moved_on"), F.lit("return").alias("kind"),
                                   F.col("return_id").alias("ref_id"), F.coalesce(units, F.lit(0)).cast("long").alias("change")))


def inventory_ledger(inventory: DataFrame, fact_sales: DataFrame, returns: DataFrame) -> DataFrame:
    """Each movement of a stocked product with ``balance_after``; the last one leaves today's stock.

    Movements of a product are ordered by day, returns before sales, then by id.
    """
    stock = inventory.groupBy("product_id").agg(F.max_by("stock_quantity", "inventory_id").cast("long").alias("stock"))
    # summed up three ways, each of which would number and join the lines again
    moves = written_once(movements(fact_sales, returns))
    opening = moves.groupBy("product_id").agg(F.sum("change").alias("all_changes")).join(stock, "product_id") \
        .select("product_id", (F.col("stock") - F.col("all_changes")).alias("opening"))
    summed = running_sum(moves, ["product_id"], F.col("moved_on"), ["moved_on", "kind", "ref_id"], "change", "moved")
    return summed.join(opening, "product_id").select(
        "product_id", "moved_on", "kind", "ref_id", "change", (F.col("opening") + F.col("moved")).alias("balance_after"))


def inventory_movement(inventory: DataFrame, fact_sales: DataFrame, returns: DataFrame) -> DataFrame:
    """Per stocked product: opening stock, units sold and returned, closing stock, lowest balance and
    when it was first reached, first day the balance was at or under the reorder level.

    Products without movements open and close with today's stock.
    """
    level = inventory.groupBy("product_id").agg(F.max_by("reorder_level", "inventory_id").cast("long").alias("reorder_level"),
                                                F.max_by("stock_quantity", "inventory_id").cast("long").alias("closing"))
    ledger = inventory_ledger(inventory, fact_sales, returns).join(level, "product_id")
    per = ledger.groupBy("product_id").agg(
        F.coalesce(F.sum(F.when(F.col("kind") == "sale", -F.col("change"))), F.lit(0)).alias("sold"),
        F.coalesce(F.sum(F.when(F.col("kind") == "return", F.col("change"))), F.lit(0)).alias("returned"),
        F.min("balance_after").alias("lowest"),
        F.min_by("moved_on", F.struct("balance_after", "moved_on")).alias("lowest_on"),
        F.min(F.when(F.col("balance_after") <= F.col("reorder_level"), F.col("moved_on"))).alias("first_at_reorder"),
        F.count_if(F.col("balance_after") < 0).alias("movements_below_zero"))
    out = level.join(per, "product_id", "left")
    sold, returned = F.coalesce("sold", F.lit(0)), F.coalesce("returned", F.lit(0))
    return out.select("product_id", (F.col("closing") + sold - returned).alias("opening"), sold.alias("sold"), returned.alias("returned"),
                      "closing", F.coalesce("lowest", "closing").alias("lowest"), "lowest_on", "first_at_reorder",
                      F.coalesce("movements_below_zero", F.lit(0)).alias("movements_below_zero"))
