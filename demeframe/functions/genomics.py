"""Nucleotide codes, bit sets of samples, and distance formulas as Columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Codes 0 to 3, and the IUPAC symbol of alleles (i, j) at 4 * i + j for i <= j; others are N.
BASES = "ACGT"
IUPAC = "AMRWNCSYNNGKNNNT"


def base_code(base: Column) -> Column:
    """A, C, G, T in either case as 0 to 3; null for all else."""
    at = F.instr(F.lit(BASES), F.upper(base))
    return F.when((F.length(base) == 1) & (at > 0), at - 1)


def base_letter(code: Column) -> Column:
    return F.substring(F.lit(BASES), code + 1, F.lit(1))


def iupac(a1: Column, a2: Column) -> Column:
    """Symbol of a genotype."""
    return F.substring(F.lit(IUPAC), a1 * 4 + a2 + 1, F.lit(1))


def bit(sample: Column) -> Column:
    """The mask of one sample."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), sample.cast("int"))


def has_bit(mask: Column, sample: Column | int) -> Column:
    return F.call_function("getbit", mask, (sample if isinstance(sample, Column) else F.lit(sample)).cast("int")) == 1


def bits(mask: Column) -> Column:
    return F.bit_count(mask).cast("long")


def hamming(a: Column, b: Column) -> Column:
    return bits(a.bitwiseXOR(b))


def canonical(mask: Column, pop: Column) -> Column:
    """A split of a population, whichever side is written: the side without its lowest sample."""
    low = pop.bitwiseAND(-pop)
    return F.when(mask.bitwiseAND(low) != 0, pop.bitwiseXOR(mask)).otherwise(mask)


def jukes_cantor(p: Column) -> Column:
    """Corrected distance; null where p is 3/4 or more."""
    inside = F.lit(1.0) - F.lit(4.0) * p / F.lit(3.0)
    return F.when(inside > 0, F.lit(-0.75) * F.ln(inside))


def harmonic(n: int, power: int = 1) -> float:
    """Sum of 1 / j ** power for 1 <= j < n."""
    return sum(1.0 / j**power for j in range(1, n))


def by_size(values: Sequence[float], n: Column) -> Column:
    """``values[n]`` of a fixed list."""
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), n.cast("int") + 1)


def tajima_constants(n: int) -> tuple[float, float, float, float]:
    """a1, a2, e1, e2 of a sample of n."""
    if n < 2:
        return 0.0, 0.0, 0.0, 0.0
    a1, a2 = harmonic(n), harmonic(n, 2)
    b1, b2 = (n + 1) / (3 * (n - 1)), 2 * (n * n + n + 3) / (9 * n * (n - 1))
    return a1, a2, (b1 - 1 / a1) / a1, (b2 - (n + 2) / (a1 * n) + a2 / a1**2) / (a1**2 + a2)


MOST_SAMPLES = 64


def constants(k: int) -> list[float]:
    return [tajima_constants(n)[k] for n in range(MOST_SAMPLES + 2)]


def tajima_d(sum_weights: Column, segregating: Column, n: Column) -> Column:
    """Null for fewer than four samples, whose variance is 0."""
    s = segregating.cast("double")
    variance = by_size(constants(2), n) * s + by_size(constants(3), n) * s * (s - 1)
    return F.when((n >= 4) & (s > 0), F.try_divide(sum_weights, F.sqrt(variance)))


def faywu_h(sum_weights: Column, segregating: Column, n: Column) -> Column:
    s, m = segregating.cast("double"), n.cast("double")
    a1, a2 = by_size(constants(0), n), by_size(constants(1), n)
    after = by_size([harmonic(k + 1, 2) for k in range(MOST_SAMPLES + 2)], n)
    theta, square = F.try_divide(s, a1), F.try_divide(s * (s - 1), a1 * a1 + a2)
    cubic = F.lit(88.0) * m * m * m + F.lit(9.0) * m * m - F.lit(13.0) * m + 6
    variance = F.try_divide((m - 2) * theta, F.lit(6.0) * (m - 1)) + square * F.try_divide(F.lit(18.0) * m * m * (F.lit(3.0) * m + 2) * after - cubic, F.lit(9.0) * m * (m - 1) * (m - 1))
    return F.when((n > 1) & (s > 0) & (variance > 0), F.try_divide(sum_weights, F.sqrt(F.greatest(variance, F.lit(0.0)))))


def register_sql(spark: SparkSession) -> None:
    """SQL functions of the session: jukes_cantor(p), and tajima_d(s, n, sum_dw) of s segregating sites among n samples with their summed weights."""
    e1, e2 = (f"element_at(array({', '.join(f'{x!r}D' for x in constants(k))}), n + 1)" for k in (2, 3))
    spark.sql(f"create or replace temporary function tajima_d(s bigint, n int, sum_dw double) returns double return if(n >= 4 and s > 0, try_divide(sum_dw, sqrt({e1} * s + {e2} * s * (s - 1))), null)")
    spark.sql("create or replace temporary function jukes_cantor(p double) returns double return if(1 - 4 * p / 3 > 0, -0.75D * ln(1 - 4 * p / 3), null)")
