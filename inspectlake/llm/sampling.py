"""Bounded samples picked by a hash: the same rows on every run, at every table size."""

from pyspark.sql import functions as F


def hash_limit(wanted, rows):
    """Hashes below this (of 63 bits) are about ``wanted`` of ``rows``; never zero."""
    return min(2**63 - 1, max(1, int(2**63 * wanted) // max(1, int(rows))))


def within(hashed, wanted, rows):
    """True for about ``wanted`` of ``rows`` hashes (64-bit integers), and for all if there are fewer.

    The share has 63 bits, so no table is large enough to round it to nothing.
    """
    limit = hash_limit(wanted, rows)
    if limit == 2**63 - 1:
        return F.lit(True)
    return F.shiftrightunsigned(hashed, 1) < F.lit(limit)
