"""Declared constraints of the operational schema.

Spark enforces none of them, so the quality audits check them as data.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Primary keys, UNIQUE columns, foreign keys and ENUM domains
# of the operational tables.
# ---------------------------------------------------------------------------
PRIMARY_KEYS = {
    "regions": "region_id", "merchants": "merchant_id", "stores": "store_id",
    "customers": "customer_id", "categories": "category_id", "products": "product_id",
    "inventory": "inventory_id", "coupons": "coupon_id", "campaigns": "campaign_id",
    "orders": "order_id", "order_items": "order_item_id", "payments": "payment_id",
    "shipments": "shipment_id", "returns": "return_id", "customer_sessions": "session_id",
    "reviews": "review_id", "support_tickets": "ticket_id",
}

UNIQUE_COLUMNS = [
    ("merchants", "email"),
    ("merchants", "commercial_register_no"),
    ("stores", "domain_url"),
    ("inventory", "product_id"),
    ("orders", "order_number"),
    ("payments", "transaction_reference"),
    ("shipments", "tracking_number"),
]

# business keys of the warehouse tables (UNIQUE in the star-schema DDL)
WAREHOUSE_KEYS = [
    ("dw_dim_merchant", "merchant_id"),
    ("dw_dim_store", "store_id"),
    ("dw_dim_customer", "customer_id"),
    ("dw_dim_product", "product_id"),
    ("dw_fact_sales", "order_item_id"),
    ("dw_fact_orders", "order_id"),
]

# (child, fk column, parent, on delete): C = cascade, N = set null
FOREIGN_KEYS = [
    ("merchants", "region_id", "regions", "N"),
    ("stores", "merchant_id", "merchants", "C"),
    ("customers", "store_id", "stores", "C"),
    ("customers", "region_id", "regions", "N"),
    ("categories", "store_id", "stores", "C"),
    ("categories", "parent_category_id", "categories", "N"),
    ("products", "store_id", "stores", "C"),
    ("products", "category_id", "categories", "N"),
    ("inventory", "product_id", "products", "C"),
    ("coupons", "store_id", "stores", "C"),
    ("campaigns", "store_id", "stores", "C"),
    ("orders", "store_id", "stores", "C"),
    ("orders", "customer_id", "customers", "C"),
    ("orders", "coupon_id", "coupons", "N"),
    ("order_items", "order_id", "orders", "C"),
    ("order_items", "product_id", "products", "C"),
    ("payments", "order_id", "orders", "C"),
    ("shipments", "order_id", "orders", "C"),
    ("returns", "order_id", "orders", "C"),
    ("returns", "product_id", "products", "C"),
    ("customer_sessions", "store_id", "stores", "C"),
    ("customer_sessions", "customer_id", "customers", "N"),
    ("reviews", "product_id", "products", "C"),
    ("reviews", "customer_id", "customers", "C"),
    ("support_tickets", "merchant_id", "merchants", "C"),
]

ENUM_DOMAINS = [
    ("merchants", "subscription_plan", ["Basic", "Plus", "Pro"]),
    ("merchants", "status", ["Active", "Suspended", "Pending_Verification", "Churned"]),
    ("stores", "store_status", ["Live", "Maintenance", "Inactive"]),
    ("customers", "gender", ["Male", "Female", "Unspecified"]),
    ("coupons", "discount_type", ["Percentage", "Fixed_SAR"]),
    ("campaigns", "channel", ["Instagram", "Snapchat", "TikTok", "Google_Ads", "SMS", "WhatsApp"]),
    ("orders", "order_status", ["Pending", "Processing", "Shipped", "Delivered", "Cancelled", "Returned"]),
    ("payments", "payment_gateway", ["Mada", "STC_Pay", "Apple_Pay", "Credit_Card", "Tabby", "Tamara", "COD"]),
    ("payments", "payment_status", ["Success", "Failed", "Pending", "Refunded"]),
    ("shipments", "courier_partner", ["SMSA", "Aramex", "Saudi_Post", "Flow", "Imile"]),
    ("shipments", "shipment_status", ["Label_Created", "Picked_Up", "In_Transit", "Out_for_Delivery",
                                      "Delivered", "Failed_Delivery"]),
    ("returns", "return_reason", ["Defective", "Wrong_Item", "Size_Fit_Issue", "Changed_Mind",
                                  "Delayed_Delivery"]),
    ("returns", "return_status", ["Requested", "Approved", "Rejected", "Refunded"]),
    ("customer_sessions", "device_type", ["Mobile_iOS", "Mobile_Android", "Desktop", "Tablet"]),
    ("support_tickets", "category", ["Payment_Issue", "Shipping_Delay", "App_Integration",
                                     "Domain_Setting", "Billing"]),
    ("support_tickets", "priority", ["Low", "Medium", "High", "Urgent"]),
    ("support_tickets", "ticket_status", ["Open", "In_Progress", "Resolved", "Closed"]),
]

# CHECK (rating_score BETWEEN 1 AND 5)
RANGE_CHECKS = [("reviews", "rating_score", 1, 5)]

EVENT_TIME_COLUMNS = [
    ("orders", "order_date"),
    ("payments", "paid_at"),
    ("shipments", "shipped_at"),
    ("returns", "requested_at"),
    ("customer_sessions", "session_date"),
    ("reviews", "created_at"),
    ("support_tickets", "created_at"),
]
