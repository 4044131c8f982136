"""Column functions over alignment records: flags, CIGARs, orientation, qualities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Flag bits, and the operations that advance the reference, the query and the reference of signatures.
PAIRED, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE, READ1 = 0x1, 0x4, 0x8, 0x10, 0x20, 0x40
SECONDARY, FAILED, DUPLICATE, SUPPLEMENTARY = 0x100, 0x200, 0x400, 0x800
REFERENCE_OPS = ("M", "D", "N", "=", "X")
QUERY_OPS = ("M", "I", "S", "=", "X")
SIGNATURE_OPS = ("M", "D", "=", "X")


def has(flag: Column, bits: int) -> Column:
    return flag.bitwiseAND(bits) != 0


def is_primary(flag: Column) -> Column:
    return ~has(flag, SECONDARY | SUPPLEMENTARY)


def cigar_ops(cigar: Column) -> Column:
    """A CIGAR string as array<struct<op, len>>."""
    parts = F.regexp_extract_all(cigar, F.lit("[0-9]+[MIDNSHP=X]"), F.lit(0))
    return F.transform(parts, lambda p: F.struct(F.right(p, F.lit(1)).alias("op"), F.regexp_extract(p, "[0-9]+", 0).cast("long").alias("len")))


def cigar_sum(ops: Column, which: tuple[str, ...]) -> Column:
    """Length of the operations ``which``."""
    return F.aggregate(F.filter(ops, lambda o: o["op"].isin(*which)), F.lit(0).cast("long"), lambda acc, o: acc + o["len"])


def orientation(pos: Column, forward: Column, mate_pos: Column, mate_forward: Column) -> Column:
    """Fp, Fm, Rp or Rm: same or opposite strands; ends within two bases of each other count as Rp."""
    left = pos < mate_pos
    opposite = F.when(F.abs(pos - mate_pos) <= 2, "Rp").when(F.when(left, forward).otherwise(mate_forward), "Rp").otherwise("Rm")
    return F.when(forward != mate_forward, opposite).when(left == forward, "Fp").otherwise("Fm")


def simple_size(size: Column) -> Column:
    """A fragment size cut to its leading digits: divided by ten while above 1000, and multiplied back."""
    zeros = F.greatest(F.lit(0), F.ceil(F.log10((F.abs(size) + 1) / 1001.0)))
    step = F.pow(F.lit(10.0), zeros).cast("long")
    return F.floor(F.abs(size) / step).cast("long") * step


def overlap_length(b1: Column, e1: Column, b2: Column, e2: Column) -> Column:
    """Bases that two intervals share; -1 if they are apart."""
    shared = F.least(e1, e2) - F.greatest(b1, b2)
    return F.when(shared < 0, F.lit(-1)).otherwise(shared)


def precision_level(tech: Column, sig_type: Column) -> Column:
    """0 for read pairs, 1 for long reads, 2 for short reads' CIGARs and clips."""
    return F.when(tech == 0, 1).when(sig_type == 1, 0).otherwise(2)


def plain_shape(ops: Column, reverse: Column) -> Column:
    """Whether a CIGAR is matches with at most one skip and with clips after them only, seen in the direction of the read."""
    letters = F.array_join(F.transform(ops, lambda o: F.when(o["op"].isin("=", "X"), "M").otherwise(o["op"])), "")
    seen = F.when(reverse, F.reverse(letters)).otherwise(letters)
    return seen.rlike("^[MNS]*M[MNS]*$") & ~seen.rlike("N.*N") & ~seen.rlike("S.*M")
