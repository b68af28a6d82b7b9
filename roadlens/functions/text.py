"""Text column expressions (TXT-01..11).  All literal substring tests, no regex
except the PIN pattern; everything runs inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from roadlens.constants import (
    BADGE_DEFAULT, BADGE_RULES, CAUSE_DISPLAY, HOTSPOT_RULES, JUNCTION_WORDS, JUNCTION_ZONES,
    PIN_PATTERN, REPORT_CATEGORY_CAUSE, WARD_RULES,
)
from roadlens.functions.common import col, contains_any, first_match, map_lookup


# The characters Python's str.split() treats as whitespace (the reference splits that way).
WS_CLASS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
            + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000")


def word_count(c) -> Column:
    """TXT-01: number of whitespace-separated tokens; NULL/empty -> 0."""
    s = F.coalesce(col(c), F.lit(""))
    return F.size(F.filter(F.split(s, "[" + WS_CLASS + "]+"), lambda x: x != F.lit(""))).cast("int")


def keyword_flags(c, keywords, prefix: str) -> list[Column]:
    """TXT-02: ``{prefix}_has_{kw}`` literal, case-insensitive containment."""
    low = F.lower(F.coalesce(col(c), F.lit("")))
    return [F.contains(low, F.lit(kw)).cast("int").alias(f"{prefix}_has_{kw.replace(' ', '_')}")
            for kw in keywords]


def pin_code(c) -> Column:
    """TXT-03: 6-digit PIN after ``Pin-``, else ``unknown_pin``."""
    return F.coalesce(F.nullif(F.regexp_extract(F.coalesce(col(c), F.lit("")), PIN_PATTERN, 1), F.lit("")),
                      F.lit("unknown_pin"))


def cause_display(c) -> Column:
    """TXT-04: raw cause -> display name; unknown -> Others."""
    return map_lookup(c, CAUSE_DISPLAY, "Others")


def report_cause(category) -> Column:
    """TXT-05: report category -> cause; unknown -> others."""
    return map_lookup(category, REPORT_CATEGORY_CAUSE, "others")


def ward_category(cause, desc) -> Column:
    """TXT-06: road -> water -> infra, later groups override earlier ones."""
    lc = F.lower(F.coalesce(col(cause), F.lit("")))
    ld = F.lower(F.coalesce(col(desc), F.lit("")))
    rules = []
    for cat, causes, words in reversed(WARD_RULES):  # highest precedence first
        rules.append((lc.isin(causes) | contains_any(ld, words), cat))
    return first_match(rules, "other")


def cause_badge(cause) -> Column:
    """TXT-07: first matching badge on the lower-cased cause."""
    lc = F.lower(F.coalesce(col(cause), F.lit("")))
    return first_match([(contains_any(lc, words), label) for label, words in BADGE_RULES], BADGE_DEFAULT)


def hotspot_type(cause, desc) -> Column:
    """TXT-11: first matching type from exact cause or description keywords."""
    lc = F.lower(F.coalesce(col(cause), F.lit("")))
    ld = F.lower(F.coalesce(col(desc), F.lit("")))
    return first_match([(lc.isin(causes) | contains_any(ld, words), t) for t, causes, words in HOTSPOT_RULES],
                       "other")


def junction_zone(junction) -> Column:
    """TXT-09: ordered substring -> zone."""
    j = F.coalesce(col(junction), F.lit(""))
    return first_match([(F.contains(j, F.lit(k)), z) for k, z in JUNCTION_ZONES], "Unknown Zone")


def name_category(name, prefixes) -> Column:
    """TXT-10: category of the first matching prefix (order matters, case-insensitive)."""
    n = F.lower(col(name))
    return first_match([(n.startswith(p.lower()), cat) for p, cat in prefixes], "Other")


def missing_text(c) -> Column:
    """NULL, '', 'nan', 'none', 'null' (any case) count as missing."""
    s = col(c)
    return s.isNull() | F.lower(F.trim(s)).isin("", "nan", "none", "null")


def place_name(junction, station, corridor, fallback: str = "City Corridor") -> Column:
    """IMP-07: junction -> station -> corridor -> constant, with a ' Junction' suffix
    when no place word is present."""
    picked = first_match([(~missing_text(junction), col(junction)), (~missing_text(station), col(station)),
                          (~missing_text(corridor), col(corridor))], fallback)
    low = F.lower(picked)
    return F.when(contains_any(low, JUNCTION_WORDS), picked).otherwise(F.concat(picked, F.lit(" Junction")))
