"""String / label Column helpers (STR-*, PRJ-10/11, JSN-*). JVM-side only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import col_, rnd

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for the same results.
# ---------------------------------------------------------------------------
# Country spellings used by bank B, mapped to the canonical country names.
COUNTRY_CANONICAL = {"CH": "Switzerland", "UK": "United Kingdom", "USA": "United States", "HK": "Hong Kong"}
# Currency by domicile (either spelling); anything else is USD.
CURRENCY_BY_DOMICILE = {
    "Switzerland": "CHF", "CH": "CHF", "United Kingdom": "GBP", "UK": "GBP",
    "United States": "USD", "USA": "USD", "Hong Kong": "HKD", "HK": "HKD", "Singapore": "SGD",
}
# Abbreviations bank B applies to entity names, mapped back to the full word.
ENTITY_ABBREVIATIONS = {"Hldg": "Holdings", "Fdn": "Foundation"}
DUAL_BANKING_LABEL = "Dual-banked (Apex + Summit)"
SINGLE_BANKING_LABEL = "Single-bank"


def map_lookup(c, mapping: dict, default=None) -> Column:
    """Literal map lookup (``create_map``); unknown keys give ``default``."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    v = F.element_at(m, col_(c))
    return v if default is None else F.coalesce(v, F.lit(default))


def banking_label(dual) -> Column:
    """``IF(dual_banked, 'Dual-banked (Apex + Summit)', 'Single-bank')`` (PRJ-03)."""
    return F.when(col_(dual), F.lit(DUAL_BANKING_LABEL)).otherwise(F.lit(SINGLE_BANKING_LABEL))


def title_words(c) -> Column:
    """underscore → space, then title case (STR-05): ``fixed_income`` → ``Fixed Income``."""
    return F.initcap(F.regexp_replace(col_(c), "_", " "))


def contains_ci(c, q: str) -> Column:
    """Case-insensitive literal substring (FLT-01); ``%``/``_`` are not wildcards."""
    return F.lower(col_(c)).contains(F.lit(q.lower()))


def pipe_list(c) -> Column:
    """Pipe-joined text → array (STR-06)."""
    return F.split(col_(c), r"\|")


def sorted_join(arr, sep: str = "|") -> Column:
    """Sorted distinct array → text (AGG-08, AGG-15)."""
    return F.array_join(F.array_sort(F.array_distinct(col_(arr))), sep)


def parse_kv_tokens(c, sep: str = "=") -> Column:
    """``['name=value', ...]`` → ``array<struct<name,value>>``; ``'all'`` dropped (STR-07)."""
    kept = F.filter(col_(c), lambda t: t != F.lit("all"))

    def one(t):
        parts = F.split(t, sep, 2)
        has = F.size(parts) == 2
        return F.struct(F.when(has, F.trim(parts[0])).otherwise(F.lit("")).alias("name"),
                        F.when(has, F.trim(parts[1])).otherwise(F.trim(t)).alias("value"))
    return F.transform(kept, one)


def kv_label(pairs) -> Column:
    """Values joined by `` · ``; empty → ``(overall)`` (STR-07)."""
    vals = F.filter(F.transform(col_(pairs), lambda p: p["value"]), lambda v: v != F.lit(""))
    return F.when(F.size(vals) > 0, F.array_join(vals, " · ")).otherwise(F.lit("(overall)"))


def money_label(c) -> Column:
    """``$1.2bn`` / ``$3.4m`` / ``$5k`` / ``$12`` (STR-08)."""
    x = col_(c).cast("double")

    def fmt(v, d):  # half-up first (format_number alone rounds half-even)
        return F.regexp_replace(F.format_number(rnd(v, d), d), ",", "")
    return (F.when(x >= 1e9, F.concat(F.lit("$"), fmt(x / 1e9, 1), F.lit("bn")))
            .when(x >= 1e6, F.concat(F.lit("$"), fmt(x / 1e6, 1), F.lit("m")))
            .when(x >= 1e3, F.concat(F.lit("$"), fmt(x / 1e3, 0), F.lit("k")))
            .otherwise(F.concat(F.lit("$"), fmt(x, 0))))


def signed_pct(c) -> Column:
    """``+12.3%`` for a fraction (STR-08)."""
    x = col_(c).cast("double") * 100.0
    return F.concat(F.when(x > 0, F.lit("+")).otherwise(F.lit("")), F.format_string("%.1f", rnd(x, 1)), F.lit("%"))


def provenance_label(source_banks, dual=None) -> Column:
    """Provenance badge text (PRJ-11)."""
    sb = F.coalesce(col_(source_banks), F.lit(""))
    is_dual = F.coalesce(col_(dual), F.instr(sb, "|") > 0) if dual is not None else F.instr(sb, "|") > 0
    return (F.when(is_dual, F.lit("Apex + Summit"))
            .when(F.instr(sb, "summit") > 0, F.lit("Summit Bank"))
            .otherwise(F.lit("Apex Bank")))


def flight_risk_tone(c) -> Column:
    """≥ .70 red, ≥ .45 amber, else green (PRJ-10)."""
    x = col_(c)
    return F.when(x >= 0.7, "red").when(x >= 0.45, "amber").otherwise("green")


def attrition_tone(c) -> Column:
    """> .25 red, > .15 amber, else green (PRJ-10)."""
    x = col_(c)
    return F.when(x > 0.25, "red").when(x > 0.15, "amber").otherwise("green")


def canonical_name(c) -> Column:
    """Undo bank-side name mutations (STR-09).

    ``Last, First`` → ``First Last``; all-upper names → title case;
    entity abbreviations expanded.  Initials (``H.``) cannot be restored and
    are kept; matching compares last-name tokens and initials instead.
    """
    s = F.trim(col_(c))
    swapped = F.when(F.instr(s, ",") > 0,
                     F.concat_ws(" ", F.trim(F.substring_index(s, ",", -1)), F.trim(F.substring_index(s, ",", 1))))
    s = F.coalesce(swapped, s)
    s = F.when(s == F.upper(s), F.initcap(s)).otherwise(s)
    for short, full in ENTITY_ABBREVIATIONS.items():
        s = F.regexp_replace(s, rf"\b{short}\b", full)
    return s


def last_name_token(c) -> Column:
    """Lower-cased last token of a canonical name."""
    return F.lower(F.element_at(F.split(canonical_name(c), r"\s+"), -1))


def first_initial(c) -> Column:
    return F.lower(F.substring(canonical_name(c), 1, 1))


def email_local(c) -> Column:
    """E-mail local part without trailing digits (STR-10)."""
    return F.regexp_replace(F.lower(F.substring_index(col_(c), "@", 1)), r"\d+$", "")


def canonical_country(c) -> Column:
    """Country spelling → canonical name (STR-11)."""
    return F.coalesce(map_lookup(c, COUNTRY_CANONICAL), col_(c))


def currency_for_domicile(c) -> Column:
    return map_lookup(c, CURRENCY_BY_DOMICILE, "USD")


def digits_only(c) -> Column:
    return F.regexp_replace(col_(c), r"\D", "")


def object_uri(c, bucket: str) -> Column:
    """Prefix ``gs://bucket/`` unless the path is already absolute (STR-13)."""
    return F.when(col_(c).startswith("gs://"), col_(c)).otherwise(F.concat(F.lit(f"gs://{bucket}/"), col_(c)))


def snippet(c, n: int = 240) -> Column:
    """First ``n`` characters (PRJ-06 / STR-03)."""
    return F.substring(col_(c), 1, n)


def templated(template: str, *cols) -> Column:
    """``format_string`` template over columns (STR-14 / TVF-11)."""
    return F.format_string(template, *[col_(c) for c in cols])


def whole_number_text(c) -> Column:
    """Number → text without a trailing ``.0`` (PRJ-02)."""
    return F.round(col_(c).cast("decimal(38,10)"), 0).cast("bigint").cast("string")


def record_json(*cols) -> Column:
    """Whole record as JSON text (JSN-03)."""
    return F.to_json(F.struct(*cols)) if cols else F.to_json(F.struct("*"))


def money_m(c, n: int = 2) -> Column:
    """USD → USD millions rounded (PRJ-08)."""
    return rnd(col_(c).cast("double") / 1e6, n)
