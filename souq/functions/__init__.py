"""Column-expression helpers.  All return ``Column`` objects built from
built-in Spark functions so they stay inside whole-stage codegen."""

from .money import DEC, DEC_SUM, money, safe_ratio  # noqa: F401
from .dates import date_key, date_from_key, month_end  # noqa: F401
