"""Consent / access audit log (F14-F17 normalisation, S11 rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import (DEFAULT_USER_AGENT, GUEST_NAME, IP_HEADERS, UNKNOWN, WIDTHS, client_ip,
                              preferred_language, truncate, valid_email)


def access_log_normalize(requests: DataFrame, app_name: str = "app") -> DataFrame:
    """One audit row per request.

    IP = first non-empty of the four headers, first element of a comma
    list, trimmed, default 127.0.0.1; language 'ar' when the header mentions
    ar; blank name -> 'Guest'; blank country -> 'Unknown'; unknown geo
    fields 'Unknown'; every field truncated to its column width; e-mail
    validity flagged with the consent form's pattern.
    """
    ua = F.coalesce(F.col("user_agent"), F.lit(DEFAULT_USER_AGENT))
    name = F.coalesce(F.nullif(F.trim(F.col("full_name")), F.lit("")), F.lit(GUEST_NAME))
    email = F.coalesce(F.trim(F.col("email")), F.lit(""))
    country = F.coalesce(F.nullif(F.trim(F.col("country")), F.lit("")), F.lit(UNKNOWN))
    unknown = F.lit(UNKNOWN)
    return requests.select(
        "log_id", "user_id", "consent_status",
        truncate(ua, WIDTHS["device_info"]).alias("device_info"),
        truncate(client_ip(*[F.col(h) for h in IP_HEADERS]), WIDTHS["ip_address"]).alias("ip_address"),
        "login_time",
        truncate(name, WIDTHS["full_name"]).alias("full_name"),
        truncate(email, WIDTHS["email"]).alias("email"),
        valid_email(F.col("email")).alias("email_valid"),
        truncate(country, WIDTHS["country"]).alias("country"),
        unknown.alias("city"), unknown.alias("region"), unknown.alias("timezone"),
        truncate(preferred_language(F.col("accept_language")), WIDTHS["preferred_language"]).alias("preferred_language"),
        F.concat(F.lit("Consent "), F.lower(F.col("consent_status")), F.lit(f" via {app_name}")).alias("consent_notes"),
    )
