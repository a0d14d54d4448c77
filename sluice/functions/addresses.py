"""Addresses and networks of both IP versions as texts of bits, in built-in functions.

An address is its version and its 32 or 128 bits ("4" or "6" in front); a network is the part of that which its addresses share.
So an address is within a network where the network's text begins the address's, and a join on prefixes finds it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice.functions.columns import let

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_V4 = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"
_V4_TAIL = r":([0-9.]*\.[0-9.]*)$"


def _v4(text: Column) -> Column:
    """The 32 bits of a dotted address, else null."""
    bits = F.array_join(F.transform(F.split(text, r"\."), lambda x: F.lpad(F.conv(x, 10, 2), 8, "0")), "")
    return F.when(text.rlike(_V4), bits)


def _v6(text: Column) -> Column:
    """The 128 bits of an address in groups, one run of which may stand as ::, and whose last two may be dotted, else null."""

    def plain(own: Column) -> Column:
        tail = F.regexp_extract(own, _V4_TAIL, 1)
        low = let(F.lpad(F.conv(_v4(tail), 2, 16), 8, "0"), lambda x: F.concat(F.substring(x, 1, 4), F.lit(":"), F.substring(x, 5, 4)))
        return F.when(own.rlike(_V4_TAIL), F.lower(F.concat(F.regexp_replace(own, r"[0-9.]+$", ""), low))).otherwise(own)

    def bits(halves: Column) -> Column:
        none = F.array().cast("array<string>")
        groups = F.transform(halves, lambda half: F.when(half == "", none).otherwise(F.split(half, ":")))

        def join(own: Column) -> Column:
            every = F.flatten(own)
            valid = F.forall(every, lambda g: g.rlike("^[0-9a-f]{1,4}$")) & F.when(F.size(own) == 1, F.size(every) == 8).otherwise((F.size(own) == 2) & (F.size(every) <= 7))
            of = lambda k: F.array_join(F.transform(F.coalesce(F.get(own, k), none), lambda g: F.lpad(F.conv(g, 16, 2), 16, "0")), "")
            return F.when(valid, F.concat(of(0), F.repeat(F.lit("0"), 16 * (8 - F.size(every))), of(1)))

        return let(groups, join)

    return let(F.lower(F.regexp_replace(text, "%[^%]+$", "")), lambda own: let(F.split(plain(own), "::"), bits))


def address(text: Column) -> Column:
    """The version and bits of an address, null where it is none."""
    return F.coalesce(F.concat(F.lit("4"), _v4(text)), F.concat(F.lit("6"), _v6(text)))


def network(text: Column) -> Column:
    """The version and leading bits of an address or network; of version 4 also with a netmask or host mask in place of a length."""

    def cut(parts: Column) -> Column:
        given = F.get(parts, 1)
        number = F.when(given.rlike("^[0-9]{1,9}$"), given.cast("int"))
        count = lambda mask, bit: F.length(F.regexp_replace(mask, f"[^{bit}]", ""))
        of_mask = let(_v4(given), lambda mask: F.when(mask.rlike("^1*0*$"), count(mask, 1)).when(mask.rlike("^0*1*$"), count(mask, 0)))

        def leading(whole: Column) -> Column:
            masked = F.when(F.startswith(whole, F.lit("4")), of_mask)
            length = F.when(F.size(parts) == 1, F.length(whole) - 1).when(F.size(parts) == 2, F.coalesce(number, masked))
            return let(length, lambda n: F.when(n < F.length(whole), F.substring(whole, F.lit(1), n + 1)))

        return let(address(F.get(parts, 0)), leading)

    return let(F.split(F.trim(text), "/"), cut)
