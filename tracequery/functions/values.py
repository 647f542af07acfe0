"""Column functions on signal values and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bit(value: Column) -> Column:
    """0 or 1 for values that are just that; null for everything else."""
    return F.when(F.trim(value) == "0", 0).when(F.trim(value) == "1", 1)


def first_bit(value: Column) -> Column:
    """The same for a value's first character only, as the comparison of traces has it."""
    return bit(F.substring(F.trim(value), 1, 1))


def scalar_code(value: Column) -> Column:
    """0, 1, 2 for x, 3 for z, 255 for anything else."""
    v = F.lower(value)
    return F.when(v == "0", 0).when(v == "1", 1).when(v == "x", 2).when(v == "z", 3).otherwise(255).cast("short")


def module(name: Column) -> Column:
    """The name without its last part; empty for a name without dots."""
    return F.regexp_extract(name, r"^(?:(.*)\.)?([^.]*)$", 1)


def leaf(name: Column) -> Column:
    return F.regexp_extract(name, r"^(?:(.*)\.)?([^.]*)$", 2)


def depth(name: Column) -> Column:
    return F.size(F.split(name, r"\.")) - 1


def handshake_kind(name: Column) -> Column:
    """valid or ready for a name that ends so after a prefix or a separator, else null."""
    low = F.lower(name)
    kind = F.when(low.endswith("valid"), "valid").when(low.endswith("ready"), "ready")
    return F.when((F.length(name) > 5), kind)


def handshake_prefix(name: Column) -> Column:
    """What stands before valid or ready, without one separator."""
    return F.regexp_replace(name, r"(?i)[._]?(valid|ready)$", "")


def ratio(part: Column, whole: Column, digits: int = 9) -> Column:
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")), digits)
