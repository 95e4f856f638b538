"""Scalar functions as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES, COMPLEMENTS = "ACGTacgtNn", "TGCAtgcaNn"
_LOW = (1 << 32) - 1


def encode_base(base: Column) -> Column:
    """A, C, G, T of either case as 0 to 3; null for all else."""
    at = F.instr(F.lit("ACGT"), F.upper(base)) - 1
    return F.when((F.length(base) == 1) & (at >= 0), at)


def complement_code(code: Column) -> Column:
    return code.bitwiseXOR(F.lit(3))


def reverse_complement(seq: Column) -> Column:
    """Keeps case and N; any other letter becomes N."""
    return F.reverse(F.translate(F.regexp_replace(seq, "[^ACGTacgtNn]", "N"), BASES, COMPLEMENTS))


def compress_runs(seq: Column) -> Column:
    """One of each run of equal letters, in the letters' own case."""
    return F.regexp_replace(seq, "(?s)(.)\\1+", "$1")


def run_starts(seq: Column) -> Column:
    """Offsets at which the runs of equal letters begin."""
    n = F.length(seq)
    every = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(every, lambda i: (i == 0) | (F.substring(seq, i + 1, F.lit(1)) != F.substring(seq, i, F.lit(1))))


def _let(value: Column, body) -> Column:
    """body(value), with value computed once: nested steps would else double their size each."""
    return F.element_at(F.transform(F.array(value), body), 1)


def wrapping_add(a: Column, b: Column) -> Column:
    """The sum modulo 2**64 of two longs, from halves that can't overflow."""
    low = a.bitwiseAND(F.lit(_LOW)) + b.bitwiseAND(F.lit(_LOW))
    high = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32)
    return _let(low, lambda x: F.shiftleft(high + F.shiftrightunsigned(x, 32), 32).bitwiseOR(x.bitwiseAND(F.lit(_LOW))))


def mix64(x: Column) -> Column:
    """The invertible mix of the kernels, in columns."""
    steps = [
        lambda x: wrapping_add(F.bitwise_not(x), F.shiftleft(x, 21)),
        lambda x: x.bitwiseXOR(F.shiftrightunsigned(x, 24)),
        lambda x: _let(wrapping_add(x, F.shiftleft(x, 3)), lambda y: wrapping_add(y, F.shiftleft(x, 8))),
        lambda x: x.bitwiseXOR(F.shiftrightunsigned(x, 14)),
        lambda x: _let(wrapping_add(x, F.shiftleft(x, 2)), lambda y: wrapping_add(y, F.shiftleft(x, 4))),
        lambda x: x.bitwiseXOR(F.shiftrightunsigned(x, 28)),
        lambda x: wrapping_add(x, F.shiftleft(x, 31)),
    ]
    for step in steps:
        x = _let(x, step)
    return x


def unsigned_order(x: Column) -> Column:
    """A long whose signed order is x's order as an unsigned number."""
    return x.bitwiseXOR(F.lit(-(1 << 63)).cast("long"))


def to_unsigned_text(x: Column) -> Column:
    return F.conv(F.hex(x), 16, 10)


def from_unsigned_text(s: Column) -> Column:
    """The bit pattern of an unsigned decimal; null if it isn't one."""
    return F.when(s.rlike("^[0-9]{1,20}$") & ((F.length(s) < 20) | (s <= "18446744073709551615")), F.conv(s, 10, -10).cast("long"))


def barcode(header: Column) -> Column:
    """A BX:Z: tag's value (which may be empty), else what stands behind the first # up to white space, unless it is empty, 0 or 0_0_0."""
    tag = F.regexp_extract(header, r"(?:^|\s)BX:Z:(\S*)", 1)
    mark = F.regexp_extract(header, r"^[^#]*#(\S*)", 1)
    return F.when(header.rlike(r"(?:^|\s)BX:Z:"), tag).when(~mark.isin("", "0", "0_0_0"), mark)


def first_token(header: Column) -> Column:
    return F.regexp_extract(header, r"^\s*(\S*)", 1)


def oriented(name: Column, orientation: Column) -> Column:
    return F.concat(name, orientation)


def oriented_name(token: Column) -> Column:
    return F.regexp_replace(token, "[+\\-.]$", "")


def orientation_of(token: Column) -> Column:
    """The last letter if it is +, - or ., else +."""
    c = F.regexp_extract(token, "([+\\-.])$", 1)
    return F.when(c == "", "+").otherwise(c)


def barcode_of_molecule(mol: Column) -> Column:
    """The name without what follows its last underscore."""
    return F.regexp_replace(mol, "_[^_]*$", "")
