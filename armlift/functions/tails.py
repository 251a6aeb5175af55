"""Tail probabilities of the normal and chi-square laws as SQL expressions."""

from __future__ import annotations

import math
from functools import reduce
from statistics import NormalDist

from armlift.functions.numeric import literal

# Coefficients of the rational Chebyshev approximations to erf and
# erfc published by W. J. Cody, Math. Comp. 23 (1969), highest power first.
ERF_SMALL_NUMERATOR = (
    1.85777706184603153e-1,
    3.16112374387056560e00,
    1.13864154151050156e02,
    3.77485237685302021e02,
    3.20937758913846947e03,
)
ERF_SMALL_DENOMINATOR = (
    1.0,
    2.36012909523441209e01,
    2.44024637934444173e02,
    1.28261652607737228e03,
    2.84423683343917062e03,
)
ERFC_MIDDLE_NUMERATOR = (
    2.15311535474403846e-8,
    5.64188496988670089e-1,
    8.88314979438837594e00,
    6.61191906371416295e01,
    2.98635138197400131e02,
    8.81952221241769090e02,
    1.71204761263407058e03,
    2.05107837782607147e03,
    1.23033935479799725e03,
)
ERFC_MIDDLE_DENOMINATOR = (
    1.0,
    1.57449261107098347e01,
    1.17693950891312499e02,
    5.37181101862009858e02,
    1.62138957456669019e03,
    3.29079923573345963e03,
    4.36261909014324716e03,
    3.43936767414372164e03,
    1.23033935480374942e03,
)
ERFC_LARGE_NUMERATOR = (
    1.63153871373020978e-2,
    3.05326634961232344e-1,
    3.60344899949804439e-1,
    1.25781726111229246e-1,
    1.60837851487422766e-2,
    6.58749161529837803e-4,
)
ERFC_LARGE_DENOMINATOR = (
    1.0,
    2.56852019228982242e00,
    1.87295284992346725e00,
    5.27905102951428412e-1,
    6.05183413124413191e-2,
    2.33520497626869185e-3,
)
SMALL_LIMIT = 0.46875
MIDDLE_LIMIT = 4.0


def normal_quantile(probability: float) -> float:
    return NormalDist().inv_cdf(probability)


def two_sided_z(level: float = 0.95) -> float:
    """Critical value of a two-sided normal interval of the given level."""
    return normal_quantile(0.5 + level / 2)


def polynomial(x: str, coefficients: tuple[float, ...]) -> str:
    return reduce(lambda acc, c: f"({acc} * {x} + {literal(c)})", coefficients[1:], literal(coefficients[0]))


def quotient(x: str, numerator: tuple[float, ...], denominator: tuple[float, ...]) -> str:
    return f"{polynomial(x, numerator)} / {polynomial(x, denominator)}"


def erfc(x: str) -> str:
    """Complementary error function of a column (or short expression), relative error near 1e-15."""
    size, square = f"abs({x})", f"({x} * {x})"
    inverse = f"(1.0D / greatest({square}, 1.0D))"
    small = f"1.0D - {x} * {quotient(square, ERF_SMALL_NUMERATOR, ERF_SMALL_DENOMINATOR)}"
    middle = f"exp(-{square}) * {quotient(size, ERFC_MIDDLE_NUMERATOR, ERFC_MIDDLE_DENOMINATOR)}"
    correction = f"{inverse} * {quotient(inverse, ERFC_LARGE_NUMERATOR, ERFC_LARGE_DENOMINATOR)}"
    large = f"exp(-{square}) * ({literal(1 / math.sqrt(math.pi))} - {correction}) / greatest({size}, 1.0D)"
    upper = f"case when {size} <= {literal(MIDDLE_LIMIT)} then {middle} else {large} end"
    return (
        f"(case when {size} <= {literal(SMALL_LIMIT)} then {small} "
        f"when {x} < 0 then 2.0D - ({upper}) else {upper} end)"
    )


def normal_cdf(z: str) -> str:
    return f"(0.5D * {erfc(f'(-{z} / {literal(math.sqrt(2))})')})"


def normal_two_sided(z: str) -> str:
    """Probability of a standard normal at least as far from 0 as ``z``."""
    return erfc(f"(abs({z}) / {literal(math.sqrt(2))})")


def chi2_tail(x: str, df: str) -> str:
    """Upper tail of chi-square with integer degrees of freedom (finite sum).

    Successive terms differ by the factor h/a with h = x/2, and a running over
    1, 2, .. (even df) or 3/2, 5/2, .. (odd df); the odd case adds erfc(sqrt(h)).
    """
    half, df = f"({x} / 2.0D)", f"cast({df} as int)"
    even = f"{df} % 2 = 0"
    first = f"exp(-{half}) * if({even}, 1.0D, sqrt({half}) * {literal(2 / math.sqrt(math.pi))})"
    steps = f"if({df} >= 2, sequence(1, cast(floor({df} / 2) as int)), cast(array() as array<int>))"
    terms = (
        f"aggregate({steps}, named_struct('term', {first}, 'total', 0.0D), "
        f"(s, i) -> named_struct('term', s.term * {half} / (i + if({even}, 0.0D, 0.5D)), 'total', s.total + s.term), "
        "s -> s.total)"
    )
    return (
        f"(case when {df} <= 0 then 1.0D when {x} is not null "
        f"then least(1.0D, {terms} + if({even}, 0.0D, {erfc(f'sqrt({half})')})) end)"
    )
