"""Access-log normalisation (F14-F17) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# IP header precedence, field widths, e-mail pattern, defaults.
# ---------------------------------------------------------------------------
IP_HEADERS = ["cf_connecting_ip", "true_client_ip", "x_forwarded_for", "x_real_ip"]
DEFAULT_IP = "127.0.0.1"
DEFAULT_LANGUAGE_HEADER = "en-US"
GUEST_NAME = "Guest"
UNKNOWN = "Unknown"
DEFAULT_USER_AGENT = "Mozilla/5.0 (Windows NT 10.0; Win64; x64) Desktop"
WIDTHS = {"device_info": 240, "ip_address": 40, "full_name": 255, "email": 255, "country": 100,
          "city": 100, "region": 100, "timezone": 100, "preferred_language": 50}
EMAIL_PATTERN = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"


def first_non_empty(*cols: Column) -> Column:
    """first argument that is neither NULL nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def client_ip(*headers: Column) -> Column:
    """first non-empty header, part before the first comma, trimmed, default loopback."""
    raw = first_non_empty(*headers)
    return F.coalesce(F.nullif(F.trim(F.substring_index(raw, ",", 1)), F.lit("")), F.lit(DEFAULT_IP))


def preferred_language(accept_language: Column) -> Column:
    """'ar' when the header mentions ar, else 'en' (missing header = en-US)."""
    h = F.lower(F.coalesce(accept_language, F.lit(DEFAULT_LANGUAGE_HEADER)))
    return F.when(h.contains("ar"), "ar").otherwise("en")


def truncate(c: Column, width: int) -> Column:
    """F16: keep the first ``width`` characters."""
    return F.substring(c, 1, width)


def valid_email(c: Column) -> Column:
    """the consent form's e-mail check."""
    return F.coalesce(F.trim(c).rlike(EMAIL_PATTERN), F.lit(False))
