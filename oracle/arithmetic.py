"""SQL text for exact half-up division.

DuckDB divides decimals in floating point, which misplaces ties, so quotients
are formed from whole numbers.
"""

from __future__ import annotations


def cents(amount: str) -> str:
    return f"(({amount}) * 100)::HUGEINT"


def _scaled(numerator: str, denominator: str, digits: int) -> str:
    """``numerator / denominator * 10 ** digits`` as a whole number, rounded half up."""
    n, d = f"({numerator})::HUGEINT", f"({denominator})::HUGEINT"
    rounded = f"(abs({n}) * {2 * 10**digits} + abs({d})) // nullif(2 * abs({d}), 0)"
    return f"(sign({n}) * sign({d}) * ({rounded}))"


def _placed(whole: str, digits: int, kind: str) -> str:
    unit = f"0.{'0' * (digits - 1)}1"
    return f"(({whole})::DECIMAL(30,0) * {unit})::{kind}"


def quotient(numerator: str, denominator: str, digits: int = 2) -> str:
    return _placed(_scaled(numerator, denominator, digits), digits, f"DECIMAL(38,{digits})")


def percent(part: str, whole: str, digits: int = 2) -> str:
    return quotient(f"100 * ({part})", whole, digits)


def money_percent(part: str, whole: str, digits: int = 2) -> str:
    return percent(cents(part), cents(whole), digits)


def money_ratio(amount: str, count: str) -> str:
    return quotient(cents(amount), f"100 * ({count})")


def money_growth(now: str, before: str) -> str:
    return money_percent(f"{now} - {before}", before)


def mean6(total: str, count: str) -> str:
    """An average to six decimals."""
    return _placed(_scaled(total, count, 6), 6, "DECIMAL(38,6)")


def mean2(total: str, count: str) -> str:
    """An average to six decimals, then rounded to two."""
    return f"{quotient(_scaled(total, count, 6), '1000000')}::DECIMAL(12,2)"
