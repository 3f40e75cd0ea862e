"""Scalar functions of the search: bit scores, E-values and their text form."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# Karlin-Altschul parameters of BLOSUM62, gapped (11, 1) and ungapped.
GAPPED_LAMBDA, GAPPED_LOG_K = 0.267, math.log(0.041)
UNGAPPED_LAMBDA, UNGAPPED_LOG_K = 0.309, math.log(0.141)


def bit_score(raw: Column, gapped: bool = True) -> Column:
    """Bit score of a raw score, cut to an integer."""
    lam, log_k = (GAPPED_LAMBDA, GAPPED_LOG_K) if gapped else (UNGAPPED_LAMBDA, UNGAPPED_LOG_K)
    return ((lam * raw - log_k) / math.log(2)).cast("int")


def raw_score(bit: Column, gapped: bool = True) -> Column:
    """Raw score that has this bit score, before it is cut."""
    lam, log_k = (GAPPED_LAMBDA, GAPPED_LOG_K) if gapped else (UNGAPPED_LAMBDA, UNGAPPED_LOG_K)
    return (bit * math.log(2) + log_k) / lam


def e_value(bit: Column, n_sequences: Column | int, qlen: Column, slen: Column) -> Column:
    """Expected chance hits: D * m * n * 2 ** -bit."""
    d = n_sequences if isinstance(n_sequences, Column) else F.lit(float(n_sequences))
    return d.cast("double") * qlen * slen * F.pow(F.lit(2.0), -bit)


def e_value_text(e: Column) -> Column:
    """0, a mantissa with two cut decimals and an exponent below 0.001, else the plain number."""
    power = F.floor(F.log10(e))
    mantissa = F.floor(e / F.pow(F.lit(10.0), power) * 100) / 100
    # a logarithm just off an integer
    mantissa, power = F.when(mantissa >= 10, mantissa / 10).otherwise(mantissa), F.when(mantissa >= 10, power + 1).otherwise(power)
    return F.when(e <= 0, "0").when(e < 1e-3, F.concat(F.format_number(mantissa, 2), F.lit("e"), F.format_string("%03d", power.cast("int")))).otherwise(e.cast("string"))


def choose(n: Column, k: Column) -> Column:
    """Binomial coefficient, 0 for more of ``k`` than ``n``."""
    rows = F.aggregate(F.sequence(F.lit(1), k), F.lit(1.0), lambda acc, i: acc * (n - k + i) / i)
    return F.when(k > n, 0).when(k == 0, 1).otherwise(F.round(rows)).cast("bigint")


def two_decimals(x: Column) -> Column:
    """Cut, not rounded, to two decimals."""
    return F.floor(x * 100) / 100
