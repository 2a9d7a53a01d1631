"""Functions of nucleotide sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Vectors over C, A, T, G of each base and ambiguity code.
BASES = {
    "C": (1.0, 0.0, 0.0, 0.0),
    "A": (0.0, 1.0, 0.0, 0.0),
    "T": (0.0, 0.0, 1.0, 0.0),
    "G": (0.0, 0.0, 0.0, 1.0),
    "Y": (0.5, 0.0, 0.5, 0.0),
    "R": (0.0, 0.5, 0.0, 0.5),
    "W": (0.0, 0.5, 0.5, 0.0),
    "S": (0.5, 0.0, 0.0, 0.5),
    "K": (0.0, 0.0, 0.5, 0.5),
    "M": (0.5, 0.5, 0.0, 0.0),
    "D": (0.0, 0.33, 0.33, 0.33),
    "V": (0.33, 0.33, 0.0, 0.33),
    "H": (0.33, 0.33, 0.33, 0.0),
    "B": (0.33, 0.0, 0.33, 0.33),
    "N": (0.25, 0.25, 0.25, 0.25),
}
#: Each code and its complement.
CODES, COMPLEMENTS = "ACGTRYKMBVDHWSN", "TGCAYRMKVBHDWSN"


def _map(pairs) -> Column:
    return F.create_map(*[x for pair in pairs for x in pair])


def encode(base: Column) -> Column:
    """Vector of a base; an error for a character that is no code."""
    known = F.element_at(_map((F.lit(b), F.array(*map(F.lit, v))) for b, v in BASES.items()), F.upper(base))
    return F.when(known.isNotNull(), known).otherwise(F.raise_error(F.concat(F.lit("no base: "), base)).cast("array<double>"))


def encode_all(seq: Column) -> Column:
    """Vectors of all bases of a sequence."""
    table = _map((F.lit(b), F.array(*map(F.lit, v))) for b, v in BASES.items())
    return F.transform(F.split(F.upper(seq), ""), lambda b: F.element_at(table, b))


def decode(vector: Column) -> Column:
    """The code of a vector; null for padding."""
    text = lambda v: F.array_join(F.transform(v, lambda x: F.format_number(x, 2)), ",")
    return F.element_at(_map((F.lit(",".join(f"{x:.2f}" for x in v)), F.lit(b)) for b, v in BASES.items()), text(vector))


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, CODES, COMPLEMENTS))


def reverse_complement_vectors(x: Column) -> Column:
    """The same for vectors: the order of bases is such that the reversed vector is the complement's."""
    return F.reverse(F.transform(x, lambda v: F.reverse(v)))


def canonical(mer: Column) -> Column:
    return F.least(mer, reverse_complement(mer))


def kmers(seq: Column, k: int) -> Column:
    """All k-mers of a sequence, in linear time; none if it is shorter."""
    n, bases = F.length(seq), F.split(seq, "")
    shifted = [F.slice(bases, F.lit(j + 1), n - k + 1) for j in range(k)]
    joined = shifted[0]
    for more in shifted[1:]:
        joined = F.zip_with(joined, more, lambda a, b: F.concat(a, b))
    return F.when(n >= k, joined).otherwise(F.array().cast("array<string>"))
