"""Domain adapter: deterministic views of the merchant schema over the
driver's TPC-H-like tables.

Every rule is a per-row expression over one driver scan (the few table
cardinalities the rules need are measured once per session, see
``Domain.sizes``): no shuffle, and Catalyst prunes the columns each query
needs down to the Parquet reader.  The only bounded broadcasts are
``nation`` (25 rows) and ``region`` (5 rows), fixed by the TPC-H spec.

Rules (N = count(supplier), S = floor(1.2 N) stores, money scaled by 0.002):

=================  ==========================================================
merchants          one per supplier; plan by key%20 (<10 Basic, <17 Plus, Pro);
                   status key%10=3 Churned, key%20=7 Suspended,
                   key%50=11 Pending_Verification, else Active
stores             ids 0..N-1 owned by the same merchant (key%50=49: by key-1,
                   leaving merchants without a store), ids N..S-1 owned by id-N
customers          store = key % S; gender by key%3; e-mail NULL when key%25=0
categories         one per part whose key%50 != 0, named after p_type
products           one per part; category NULL when key%50=0; cost = 55 % of price
inventory          one per part whose key%40 != 7
orders             store = key % S; discount 0/10/15 % by key%3; VAT 15 %;
                   shipping 25; defects: VAT +2.00 when key%97=0, net +1.00
                   when key%101=0
order_items        one per line; id = orderkey*10^7 + number of the line in the order:
                   s = (partkey+suppkey+linenumber) % 256, then
                   (place among the lines of the order with that s - 1) * 256 + s + 1
payments           none when key%17=0; a second later one when key%13=0;
                   orphan (order id negated) when key%1009=5
shipments          none for status P; a second one when key%11=0
returns            lines with returnflag R
customer_sessions  one per event; cart = click/purchase, checkout = purchase
support_tickets    error events; merchant = user % N
reviews            one per label row; rating 1/3/5 from quality and toxic
coupons/campaigns  one per store
=================  ==========================================================
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.money import DEC, money
from .driver import read_table

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's domain vocabularies.
# ---------------------------------------------------------------------------
PLANS = ["Basic", "Plus", "Pro"]
INDUSTRIES = [
    "Abayas & Fashion", "Oud & Perfumes", "Saudi Dates & Sweets",
    "Electronics", "Beauty & Cosmetics", "Home & Kitchen",
]
GATEWAYS = ["Mada", "STC_Pay", "Apple_Pay", "Credit_Card", "Tabby", "Tamara", "COD"]
COURIERS = ["SMSA", "Aramex", "Saudi_Post", "Flow", "Imile"]
CAMPAIGN_CHANNELS = ["Instagram", "Snapchat", "TikTok", "Google_Ads", "SMS", "WhatsApp"]
DEVICES = ["Mobile_iOS", "Mobile_Android", "Desktop", "Tablet"]
GENDERS = ["Male", "Female", "Unspecified"]
RETURN_REASONS = ["Defective", "Wrong_Item", "Size_Fit_Issue", "Changed_Mind", "Delayed_Delivery"]
RETURN_STATUSES = ["Requested", "Approved", "Rejected", "Refunded"]
TICKET_CATEGORIES = ["Payment_Issue", "Shipping_Delay", "App_Integration", "Domain_Setting", "Billing"]
TICKET_PRIORITIES = ["Low", "Medium", "High", "Urgent"]
TICKET_STATUSES = ["Open", "In_Progress", "Resolved", "Closed"]
# Adapter-only vocabulary (the reference leaves channel_source free text).
SESSION_CHANNELS = ["Direct", "Instagram", "Google", "TikTok", "Snapchat"]

DEFAULT_AS_OF = dt.date(2001, 8, 2)
ITEM_SALTS = 256
LINES_PER_ORDER = 10_000_000
BASE_DATE = dt.date(1995, 1, 1)


def pick(values: list[str], idx: Column) -> Column:
    """values[idx % len(values)] for a non-negative integral index."""
    arr = F.array(*[F.lit(v) for v in values])
    return F.element_at(arr, (idx % len(values)).cast("int") + 1)


def _days(n: Column) -> Column:
    return F.make_dt_interval(days=n.cast("int"))


def order_money(o: DataFrame) -> DataFrame:
    """Per-row order pricing rule of the adapter (also used on streams)."""
    k = F.col("o_orderkey")
    rate = F.when(k % 3 == 0, F.lit(Decimal("0.00"))).when(k % 3 == 1, F.lit(Decimal("0.10"))) \
        .otherwise(F.lit(Decimal("0.15")))
    gross = money(F.col("o_totalprice"))
    o = o.withColumns({"discount_rate": rate, "gross_amount": gross})
    o = o.withColumn("discount_amount", F.round(F.col("gross_amount") * F.col("discount_rate"), 2).cast(DEC))
    vat = F.round((F.col("gross_amount") - F.col("discount_amount")) * F.lit(Decimal("0.15")), 2) \
        + F.when(k % 97 == 0, F.lit(Decimal("2.00"))).otherwise(F.lit(Decimal("0.00")))
    o = o.withColumns({"vat_amount": vat.cast(DEC), "shipping_fee": F.lit(Decimal("25.00")).cast(DEC)})
    net = (F.col("gross_amount") - F.col("discount_amount") + F.col("vat_amount") + F.col("shipping_fee")
           + F.when(k % 101 == 0, F.lit(Decimal("1.00"))).otherwise(F.lit(Decimal("0.00"))))
    return o.withColumn("net_amount", net.cast(DEC))


def access_requests(events: DataFrame) -> DataFrame:
    """Raw consent/login requests derived per event (headers as a client sends them).

    Adapter rules: status REJECTED for error events; IP headers rotate by
    event id (empty strings, a comma list in X-Forwarded-For, or none at
    all); Accept-Language ar / en / missing; blank names; malformed e-mails.
    """
    i, u = F.col("event_id"), F.col("user_id")
    octet = lambda c: (c % 256).cast("string")
    return events.select(
        i.alias("log_id"),
        F.concat(F.lit("USR-"), F.lpad(u.cast("string"), 8, "0")).alias("user_id"),
        F.when(F.col("event_type") == "error", "REJECTED").otherwise("ACCEPTED").alias("consent_status"),
        F.when(i % 3 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("agent-"), i.cast("string"), F.lit(" "), F.repeat(F.lit("x"), (i % 300).cast("int"))))
        .alias("user_agent"),
        F.when(i % 4 == 0, F.lit("")).alias("cf_connecting_ip"),
        F.when(i % 4 == 1, F.concat(F.lit("10.1."), octet(u), F.lit("."), octet(i))).alias("true_client_ip"),
        F.when((i % 4 == 0) | (i % 4 == 2), F.concat(F.lit(" 10.2."), octet(u), F.lit("."), octet(i),
                                                     F.lit(" , 172.16.0."), (i % 7).cast("string")))
        .alias("x_forwarded_for"),
        F.when(i % 4 == 3, F.lit("")).alias("x_real_ip"),
        F.when(i % 3 == 0, "ar-SA,ar;q=0.9").when(i % 3 == 1, "en-US").alias("accept_language"),
        F.when(i % 5 == 0, F.lit("  ")).otherwise(F.concat(F.lit("User "), u.cast("string"))).alias("full_name"),
        F.when(i % 6 == 0, F.lit("bad-email")).otherwise(
            F.concat(F.lit("user"), u.cast("string"), F.lit("@example.com"))).alias("email"),
        F.lit("").alias("country"),
        F.col("ts").cast("timestamp").alias("login_time"),
    )


def numbered_items(li: DataFrame) -> DataFrame:
    """The order items made of lines, wherever those are read from or dealt to."""
    others = ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
              "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    # Lines are numbered within (order, salt), and the salt is the number's
    # remainder: unique within the order after one scan and one shuffle,
    # and an order holding a third of all lines is spread over its salts.
    # A query that does not output the id drops the window with it.
    salt = (F.col("l_partkey") + F.col("l_suppkey") + F.col("l_linenumber")) % ITEM_SALTS
    within = F.row_number().over(Window.partitionBy("l_orderkey", "_salt").orderBy(*others))
    li = li.withColumn("_salt", salt).withColumn("_line_no", (within - 1) * ITEM_SALTS + F.col("_salt") + 1)
    unit = money(F.col("l_extendedprice"))
    qty = F.col("l_quantity").cast("int")
    return li.select(
        # an order with more lines than its ids would run into the next one's: fail loudly
        F.when(F.col("_line_no") < LINES_PER_ORDER, F.col("l_orderkey") * LINES_PER_ORDER + F.col("_line_no"))
        .otherwise(F.raise_error(F.lit(f"an order has {LINES_PER_ORDER} lines or more")).cast("long"))
        .alias("order_item_id"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("product_id"),
        qty.alias("quantity"),
        unit.alias("unit_price"),
        (unit * qty).cast(DEC).alias("total_price"),
        F.col("l_linenumber").alias("line_number"),
        F.col("l_returnflag"),
        F.col("l_shipdate").cast("timestamp").alias("ship_date"),
    )


def returned_items(order_items: DataFrame) -> DataFrame:
    """The returns among order items, wherever those are read from."""
    k = F.col("order_id")
    return order_items.where(F.col("l_returnflag") == "R").select(
        F.col("order_item_id").alias("return_id"),
        k.alias("order_id"),
        F.col("product_id"),
        pick(RETURN_REASONS, k).alias("return_reason"),
        F.col("total_price").alias("refund_amount"),
        pick(RETURN_STATUSES, k).alias("return_status"),
        (F.col("ship_date") + _days(F.lit(7))).alias("requested_at"),
    )


class Domain:
    """Lazy domain tables over one driver directory."""

    def __init__(self, spark: SparkSession, sf_dir: str, as_of: dt.date = DEFAULT_AS_OF):
        self.spark = spark
        self.sf_dir = sf_dir
        self.as_of = as_of
        self._raw: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        if name not in self._raw:
            self._raw[name] = read_table(self.spark, self.sf_dir, name)
        return self._raw[name]

    # -- table cardinalities -------------------------------------------------
    # Adapter parameters (store count, key moduli) depend on the row counts
    # of three small driver tables.  They are measured once per Domain with a
    # single aggregate job and enter the plans as literals; ``star_for`` makes
    # a new Domain whenever the files of the directory change.
    @cached_property
    def sizes(self) -> dict:
        return self.spark.range(1).select(
            self.raw("supplier").select(F.count(F.lit(1))).scalar().alias("n_m"),
            self.raw("part").select(F.count(F.lit(1))).scalar().alias("n_p"),
            self.raw("customer").select(F.count(F.lit(1))).scalar().alias("n_c"),
        ).first().asDict()

    @property
    def n_merchants(self) -> Column:
        return F.lit(int(self.sizes["n_m"]))

    @property
    def n_stores(self) -> Column:
        return F.lit(int(self.sizes["n_m"]) * 6 // 5)

    @property
    def n_products(self) -> Column:
        return F.lit(int(self.sizes["n_p"]))

    @property
    def n_customers(self) -> Column:
        return F.lit(int(self.sizes["n_c"]))

    def _nation_region(self) -> DataFrame:
        # 25 rows by the TPC-H spec: a bounded broadcast.
        return F.broadcast(self.raw("nation").select(
            F.col("n_nationkey"), F.col("n_regionkey").cast("long").alias("region_id")))

    # -- operational tables --------------------------------------------------
    @cached_property
    def regions(self) -> DataFrame:
        r = self.raw("region")
        return r.select(
            F.col("r_regionkey").cast("long").alias("region_id"),
            F.col("r_name").alias("region_name_en"),
            F.col("r_name").alias("region_name_ar"),
            F.lit("SA").alias("country_code"),
            F.lit(True).alias("is_active"),
            F.lit(dt.datetime(1995, 1, 1)).cast("timestamp").alias("created_at"),
        )

    @cached_property
    def merchants(self) -> DataFrame:
        s = self.raw("supplier")
        k = F.col("s_suppkey")
        joined = F.date_add(F.lit(BASE_DATE), (k * 7 % 1500).cast("int"))
        return (
            s.join(self._nation_region(), s.s_nationkey == F.col("n_nationkey"), "left")
            .select(
                k.alias("merchant_id"),
                F.col("s_name").alias("merchant_name"),
                F.concat(F.lit("merchant_"), k.cast("string"), F.lit("@example.com")).alias("email"),
                F.concat(F.lit("+9665"), F.lpad((k % 100000000).cast("string"), 8, "0")).alias("phone"),
                F.when(k % 20 < 10, "Basic").when(k % 20 < 17, "Plus").otherwise("Pro").alias("subscription_plan"),
                F.concat(F.lit("1"), F.lpad(k.cast("string"), 9, "0")).alias("commercial_register_no"),
                F.concat(F.lit("3"), F.lpad(k.cast("string"), 14, "0")).alias("vat_number"),
                F.when(k % 10 == 3, "Churned").when(k % 20 == 7, "Suspended")
                .when(k % 50 == 11, "Pending_Verification").otherwise("Active").alias("status"),
                joined.alias("joined_date"),
                F.col("region_id"),
                joined.cast("timestamp").alias("created_at"),
            )
        )

    @cached_property
    def stores(self) -> DataFrame:
        s = self.raw("supplier")
        n = self.n_merchants
        k = F.col("s_suppkey")
        # one scan: a second store for the first S-N suppliers
        extra = F.when(k < self.n_stores - n, 1).otherwise(0)
        x = s.select(k, F.explode(F.sequence(F.lit(0), extra)).alias("seq"))
        store_id = (k + F.col("seq") * n).cast("long")
        merchant_id = F.when((F.col("seq") == 0) & (k % 50 == 49), k - 1).otherwise(k)
        return x.select(store_id.alias("store_id"), merchant_id.alias("merchant_id")).select(
            "store_id",
            "merchant_id",
            F.concat(F.lit("Store "), F.col("store_id").cast("string")).alias("store_name_en"),
            F.concat(F.lit("Store "), F.col("store_id").cast("string")).alias("store_name_ar"),
            F.concat(F.lit("https://store-"), (F.col("store_id") + 100).cast("string"),
                     F.lit(".example.sa")).alias("domain_url"),
            pick(INDUSTRIES, F.col("store_id")).alias("industry_category"),
            F.when(F.col("store_id") % 20 == 19, "Maintenance")
            .when(F.col("store_id") % 25 == 24, "Inactive").otherwise("Live").alias("store_status"),
            F.lit(dt.datetime(1995, 1, 1)).cast("timestamp").alias("created_at"),
        )

    @cached_property
    def customers(self) -> DataFrame:
        c = self.raw("customer")
        k = F.col("c_custkey")
        return (
            c.join(self._nation_region(), c.c_nationkey == F.col("n_nationkey"), "left")
            .select(
                k.alias("customer_id"),
                (k % self.n_stores).cast("long").alias("store_id"),
                F.col("c_name").alias("full_name"),
                F.when(k % 25 == 0, F.lit(None).cast("string"))
                .otherwise(F.concat(F.lit("customer"), k.cast("string"), F.lit("@example.com"))).alias("email"),
                F.concat(F.lit("+9665"), F.lpad((k % 100000000).cast("string"), 8, "0")).alias("phone_number"),
                F.col("region_id"),
                pick(GENDERS, k).alias("gender"),
                F.lit(0).alias("total_orders_count"),
                F.lit(dt.datetime(1995, 1, 1)).cast("timestamp").alias("created_at"),
            )
        )

    @cached_property
    def categories(self) -> DataFrame:
        p = self.raw("part")
        k = F.col("p_partkey")
        return p.where(k % 50 != 0).select(
            k.alias("category_id"),
            (k % self.n_stores).cast("long").alias("store_id"),
            F.col("p_type").alias("category_name_en"),
            F.col("p_type").alias("category_name_ar"),
            F.lit(None).cast("long").alias("parent_category_id"),
        )

    @cached_property
    def products(self) -> DataFrame:
        p = self.raw("part")
        k = F.col("p_partkey")
        base = money(F.col("p_retailprice"))
        return p.select(
            k.alias("product_id"),
            (k % self.n_stores).cast("long").alias("store_id"),
            F.when(k % 50 == 0, F.lit(None).cast("long")).otherwise(k).alias("category_id"),
            F.col("p_name").alias("product_name_en"),
            F.col("p_name").alias("product_name_ar"),
            F.concat(F.lit("SKU-"), F.lpad(k.cast("string"), 8, "0")).alias("sku"),
            base.alias("base_price"),
            F.round(base * F.lit(Decimal("0.55")), 2).cast(DEC).alias("cost_price"),
            (k % 30 != 29).alias("is_active"),
            F.lit(dt.datetime(1995, 1, 1)).cast("timestamp").alias("created_at"),
        )

    @cached_property
    def inventory(self) -> DataFrame:
        p = self.raw("part")
        k = F.col("p_partkey")
        return p.where(k % 40 != 7).select(
            k.alias("inventory_id"),
            k.alias("product_id"),
            (k * 37 % 500).cast("int").alias("stock_quantity"),
            (k % 16 + 5).cast("int").alias("reorder_level"),
            F.lit(dt.datetime(2001, 7, 1)).cast("timestamp").alias("last_restock_date"),
        )

    @cached_property
    def coupons(self) -> DataFrame:
        st = self.stores
        i = F.col("store_id")
        start = F.date_add(F.lit(BASE_DATE), (i * 53 % 2000).cast("int"))
        return st.select(
            i.alias("coupon_id"),
            i.alias("store_id"),
            F.concat(F.lit("SAVE"), i.cast("string")).alias("coupon_code"),
            F.when(i % 2 == 0, "Percentage").otherwise("Fixed_SAR").alias("discount_type"),
            F.when(i % 2 == 0, F.lit(Decimal("10.00"))).otherwise(F.lit(Decimal("5.00"))).cast(DEC).alias("discount_value"),
            start.alias("start_date"),
            F.date_add(start, 180).alias("end_date"),
            F.lit(0).alias("times_used"),
        )

    @cached_property
    def campaigns(self) -> DataFrame:
        st = self.stores
        i = F.col("store_id")
        start = F.date_add(F.lit(BASE_DATE), (i * 37 % 2000).cast("int"))
        return st.select(
            i.alias("campaign_id"),
            i.alias("store_id"),
            F.concat(F.lit("Campaign "), i.cast("string")).alias("campaign_name"),
            pick(CAMPAIGN_CHANNELS, i).alias("channel"),
            ((i % 20) * 25 + 50).cast(DEC).alias("ad_spend_sar"),
            start.alias("start_date"),
            F.date_add(start, 30).alias("end_date"),
        )

    def _order_money(self, o: DataFrame) -> DataFrame:
        return order_money(o)

    @cached_property
    def orders(self) -> DataFrame:
        o = self.raw("orders")
        k = F.col("o_orderkey")
        status = (
            F.when(F.col("o_orderstatus") == "P", "Pending")
            .when(F.col("o_orderstatus") == "F", "Delivered")
            .when(k % 5 == 0, "Processing").when(k % 5 == 3, "Returned")
            .when(k % 5 == 4, "Cancelled").otherwise("Shipped")
        )
        return self._order_money(o).select(
            k.alias("order_id"),
            (k % self.n_stores).cast("long").alias("store_id"),
            F.col("o_custkey").alias("customer_id"),
            F.when(k % 3 == 0, F.lit(None).cast("long")).otherwise(k % self.n_stores).cast("long").alias("coupon_id"),
            F.concat(F.lit("ORD-SAU-"), (k + 100000).cast("string")).alias("order_number"),
            status.alias("order_status"),
            "gross_amount", "discount_amount", "vat_amount", "shipping_fee", "net_amount",
            F.col("o_orderdate").cast("timestamp").alias("order_date"),
        )

    @cached_property
    def order_discount_rates(self) -> DataFrame:
        """(order_id, discount_rate): the pricing input of W13."""
        o = self.raw("orders")
        k = F.col("o_orderkey")
        rate = F.when(k % 3 == 0, F.lit(Decimal("0.00"))).when(k % 3 == 1, F.lit(Decimal("0.10"))) \
            .otherwise(F.lit(Decimal("0.15")))
        return o.select(k.alias("order_id"), rate.alias("discount_rate"))

    @cached_property
    def order_items(self) -> DataFrame:
        return numbered_items(self.raw("lineitem"))

    def order_items_dealt(self, parts: int) -> DataFrame:
        """The order items with their lines dealt out once, by order, before they are numbered.

        Numbering them, joining them by order and storing them by order in ``parts`` buckets deals
        nothing out again.  An order is whole in a task: only for results that bring it together anyway.
        """
        return numbered_items(self.raw("lineitem").repartition(parts, "l_orderkey"))

    @cached_property
    def payments(self) -> DataFrame:
        o = self._order_money(self.raw("orders")).where(F.col("o_orderkey") % 17 != 0)
        k = F.col("o_orderkey")
        x = o.withColumn("seq", F.explode(F.sequence(F.lit(0), F.when(k % 13 == 0, 1).otherwise(0))))
        pid = k * 2 + F.col("seq")
        return x.select(
            pid.alias("payment_id"),
            F.when(k % 1009 == 5, -k - 1).otherwise(k).alias("order_id"),
            pick(GATEWAYS, k + F.col("seq")).alias("payment_gateway"),
            F.when(F.col("o_orderstatus") == "P", "Pending").otherwise("Success").alias("payment_status"),
            F.concat(F.lit("TXN-"), pid.cast("string")).alias("transaction_reference"),
            F.col("net_amount").alias("amount_paid"),
            (F.col("o_orderdate").cast("timestamp") + _days(F.col("seq"))).alias("paid_at"),
        )

    @cached_property
    def shipments(self) -> DataFrame:
        o = self.raw("orders").where(F.col("o_orderstatus") != "P")
        k = F.col("o_orderkey")
        x = o.withColumn("seq", F.explode(F.sequence(F.lit(0), F.when(k % 11 == 0, 1).otherwise(0))))
        sid = k * 2 + F.col("seq")
        odate = F.col("o_orderdate").cast("timestamp")
        delivered = F.col("o_orderstatus") == "F"
        return x.select(
            sid.alias("shipment_id"),
            k.alias("order_id"),
            pick(COURIERS, k + F.col("seq")).alias("courier_partner"),
            F.concat(F.lit("TRK-"), sid.cast("string")).alias("tracking_number"),
            F.when(delivered, "Delivered").otherwise("In_Transit").alias("shipment_status"),
            (odate + _days(F.lit(1))).alias("shipped_at"),
            F.when(delivered, odate + _days(k % 4 + 2)).alias("delivered_at"),
        )

    @cached_property
    def returns(self) -> DataFrame:
        return returned_items(self.order_items)

    @cached_property
    def customer_sessions(self) -> DataFrame:
        e = self.raw("events")
        i = F.col("event_id")
        et = F.col("event_type")
        return e.select(
            i.alias("session_id"),
            (F.col("user_id") % self.n_stores).cast("long").alias("store_id"),
            F.col("user_id").alias("customer_id"),
            pick(DEVICES, i).alias("device_type"),
            pick(SESSION_CHANNELS, i).alias("channel_source"),
            (i % 9 + 1).cast("int").alias("pages_viewed"),
            et.isin("click", "purchase").alias("cart_added"),
            (et == "purchase").alias("checkout_started"),
            F.col("ts").cast("timestamp").alias("session_date"),
        )

    @cached_property
    def support_tickets(self) -> DataFrame:
        e = self.raw("events").where(F.col("event_type") == "error")
        i = F.col("event_id")
        return e.select(
            i.alias("ticket_id"),
            (F.col("user_id") % self.n_merchants).cast("long").alias("merchant_id"),
            pick(TICKET_CATEGORIES, i).alias("category"),
            pick(TICKET_PRIORITIES, i).alias("priority"),
            pick(TICKET_STATUSES, i + 1).alias("ticket_status"),
            F.col("ts").cast("timestamp").alias("created_at"),
        )

    @cached_property
    def access_requests(self) -> DataFrame:
        return access_requests(self.raw("events"))

    @cached_property
    def reviews(self) -> DataFrame:
        lb = self.raw("labels")
        d = F.col("doc_id")
        return lb.select(
            d.alias("review_id"),
            (d % self.n_products).cast("long").alias("product_id"),
            (d % self.n_customers).cast("long").alias("customer_id"),
            (F.col("quality") * 2 + (1 - F.col("toxic")) * 2 + 1).cast("int").alias("rating_score"),
            F.concat(F.lit("review "), d.cast("string")).alias("review_text"),
            F.lit(dt.datetime(2001, 1, 1)).cast("timestamp").alias("created_at"),
        )

    def table(self, name: str) -> DataFrame:
        return getattr(self, name)


OLTP_TABLES = (
    "regions", "merchants", "stores", "customers", "categories", "products",
    "inventory", "coupons", "campaigns", "orders", "order_items", "payments",
    "shipments", "returns", "customer_sessions", "reviews", "support_tickets",
)
