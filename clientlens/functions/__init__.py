"""Column-level helpers; every one is a built-in Spark SQL expression."""

from . import dates, numeric, text, vectors  # noqa: F401
