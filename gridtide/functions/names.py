"""Parsing of equipment names with built-in string functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The transmission voltages (kV) recognised as a bare token of a name.
KNOWN_KV = (765, 500, 345, 230, 220, 138, 115, 69, 46, 34)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def voltage_kv(name: Column | str, known: Sequence[int] = KNOWN_KV) -> Column:
    """First token that is a known voltage (a trailing unit or circuit letter is allowed), else the
    number of the first ``NNN KV`` anywhere in the name."""
    up = F.upper(_col(name))
    numbers = F.transform(F.split(up, r"[_\s]+"), lambda t: F.regexp_extract(t, r"^(\d{2,3})(?:KV|[A-Z])?$", 1))
    found = F.filter(numbers, lambda n: n.isin([str(k) for k in known]))
    anywhere = F.regexp_extract(up, r"(\d{2,3})\s*KV", 1)
    return F.coalesce(F.try_element_at(found, F.lit(1)), F.when(anywhere != "", anywhere)).cast("int")


def voltage_class(name: Column | str, known: Sequence[int] = KNOWN_KV) -> Column:
    kv = voltage_kv(name, known)
    return (
        F.when(kv >= 345, "345kv_up").when(kv == 230, "230kv").when(kv == 138, "138kv").otherwise("other_kv")
    )


def _strip_underscores(c: Column) -> Column:
    return F.regexp_replace(c, r"^_+|_+$", "")


def sites(name: Column | str) -> Column:
    """Stations an equipment name touches: an interface limit, one or two 8-character fields, or the
    first token."""
    up = F.upper(F.trim(_col(name)))
    first_token = F.split(up, "_")[0]
    interface = F.when(F.instr(up, "_LIMIT") > 0, F.split(up, "_LIMIT")[0]).otherwise(first_token)
    ninth = F.when(F.length(up) > 8, F.substring(up, 9, 1))
    left = _strip_underscores(F.substring(up, 1, 8))
    right = _strip_underscores(F.substring(up, 10, 8))
    return (
        F.when(up.startswith("SCH-"), F.array(interface))
        .when(ninth == "-", F.array(left, right))
        .when(ninth == "_", F.array(left))
        .otherwise(F.array(first_token))
    )


def slug(c: Column | str) -> Column:
    """Lower case with every run of other characters turned into one underscore, none at the ends."""
    return _strip_underscores(F.regexp_replace(F.lower(_col(c)), r"[^a-z0-9]+", "_"))


def decimal_comma(c: Column | str) -> Column:
    """A number written with a decimal comma."""
    return F.regexp_replace(_col(c), ",", ".").try_cast("double")
