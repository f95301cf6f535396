"""Texts of findings and suggestions, each used by a read model and its SQL.

``%s`` and ``%d`` mean the same to Spark's ``format_string`` and DuckDB's ``printf``."""

HOUSEHOLD_SIGNAL = "held by %d others of the household: %s"
LOOKALIKE_SIGNAL = "%d clients with a similar profile"
NEXT_BEST = "Offer %s to this client (%s, %s): the household has it, the client has not."
STRUCTURING = "%s: %d transfers just below the reporting limit, USD %d together"
UBO = "%s %s in %s carries a risk flag; its owner %s (%s) shares a household with %d others"
CLUSTER = "household of %d with USD %dm, %d of them with accounts at both banks"
DUAL, OUTFLOW, NEGATIVE_FLOW, OTHER = ("accounts at both banks", "outflows above 55 % of volume", "net outflow over the recent months",
                                       "no single driver")
PLAY = "%s client: book a review, open with %s."


def sql(text: str) -> str:
    """As an SQL literal."""
    return "'" + text.replace("'", "''") + "'"
