"""Statistics as Column expressions."""
from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def fisher(p1, p2, p3=None, use_third: Column | None = None) -> Column:
    """Fisher's combined p-value of two, or three where ``use_third``, p-values (floor 1e-300)."""
    ln = lambda p: F.ln(F.greatest(_c(p), F.lit(1e-300)))
    two = -(ln(p1) + ln(p2))
    tail2 = lambda t: F.exp(-t) * (1 + t)
    tail3 = lambda t: F.exp(-t) * (1 + t + t * t / 2)
    if p3 is None:
        return F.when(two <= 0, 1.0).otherwise(F.least(tail2(two), F.lit(1.0)))
    three = two - ln(p3)
    use = F.lit(True) if use_third is None else use_third
    return F.when(use, F.when(three <= 0, 1.0).otherwise(F.least(tail3(three), F.lit(1.0)))).otherwise(
        F.when(two <= 0, 1.0).otherwise(F.least(tail2(two), F.lit(1.0))))


def _steps(n: Column) -> Column:
    """0 .. n-1, empty for n <= 0."""
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def hypergeom_pmf(N, K, n, x) -> Column:
    """P(X = x) of x marked among n drawn from N with K marked, as a product of n ratios."""
    N, K, n, x = (_c(v).cast("double") for v in (N, K, n, x))
    hit = F.aggregate(_steps(x), F.lit(1.0), lambda a, i: a * (K - i) / (N - i) * (n - i) / (i + 1))
    return F.aggregate(_steps(n - x), hit, lambda a, j: a * (N - K - j) / (N - x - j))


def complement_pvalue(N, K, n, obs, midp: bool = False) -> Column:
    """Upper tail of the hypergeometric, or the mid-p for counts 0 and 1 when ``midp``."""
    N, K, n, obs = (_c(v).cast("int") for v in (N, K, n, obs))
    lo, hi = F.greatest(F.lit(0), n + K - N), F.least(K, n)
    tail = lambda start: F.aggregate(
        F.when(start <= hi, F.sequence(start, hi)).otherwise(F.array().cast("array<int>")), F.lit(0.0),
        lambda a, x: a + hypergeom_pmf(N, K, n, x))
    plain = F.when(obs <= lo, 1.0).when(obs > hi, 0.0).otherwise(tail(obs))
    if not midp:
        return plain
    mid = F.when(obs < lo, 1.0).when(obs > hi, 0.0).otherwise(tail(obs + 1) + 0.5 * hypergeom_pmf(N, K, n, obs))
    return F.when(obs <= 1, mid).otherwise(plain)


def log_factorial(n) -> Column:
    """ln n!: a sum below 30, Stirling's series (error below 1e-12) above."""
    n = _c(n).cast("double")
    small = F.aggregate(_steps(n), F.lit(0.0), lambda a, i: a + F.ln(i + F.lit(1.0)))
    x = n + 1
    big = (x - 0.5) * F.ln(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (
        1260 * F.pow(x, F.lit(5.0)))
    return F.when(n < 30, small).otherwise(big)


def _reach(variance: Column) -> Column:
    """Terms from the middle of a distribution until the rest is below the last digit: twelve deviations and more."""
    return F.ceil(60 + 12 * F.sqrt(variance)).cast("long")


def _fold(first: Column, steps: Column, ratio) -> Column:
    """first + first r(1) + first r(1) r(2) + ... over ``steps`` further terms."""
    return F.aggregate(F.when(steps > 0, F.sequence(F.lit(1).cast("long"), steps)).otherwise(F.array().cast("array<bigint>")),
                       F.struct(first.alias("t"), first.alias("s")),
                       lambda a, i: F.struct((a.t * ratio(i)).alias("t"), (a.s + a.t * ratio(i)).alias("s")), lambda a: a.s)


def poisson_upper(o, lam) -> Column:
    """P(X >= o) for a Poisson mean. Terms are summed away from the mean, from a first term taken in logs, so neither
    large means nor large counts underflow and the work grows with the square root of the mean."""
    o, lam = _c(o).cast("long"), _c(lam).cast("double")
    pmf = lambda k: F.exp(-lam + k * F.ln(lam) - log_factorial(k))
    far = _reach(F.greatest(lam, o.cast("double")))
    above = _fold(pmf(o), far, lambda i: lam / (o + i))
    below = _fold(pmf(o - 1), F.least(far, o - 1), lambda i: (o - i) / lam)
    return (F.when(o <= 0, 1.0).when(lam <= 0, 0.0).when(o > lam, F.least(above, F.lit(1.0)))
            .otherwise(F.greatest(1 - below, F.lit(0.0))))


def normal_upper(z) -> Column:
    """Upper tail of the standard normal (rational approximation, absolute error below 1.5e-7)."""
    z = _c(z)
    x = F.abs(z) / F.lit(1.4142135623730951)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    half = 0.5 * poly * F.exp(-x * x)
    return F.when(z >= 0, half).otherwise(1 - half)


def binomial_upper(n, k, p, exact_limit: int = 20000) -> Column:
    """P(X >= k) of Binomial(n, p): terms summed away from the mean up to ``exact_limit`` draws, beyond it Poisson for
    small means, else normal."""
    n, k, p = _c(n).cast("long"), _c(k).cast("long"), _c(p).cast("double")
    pmf = lambda j: F.exp(log_factorial(n) - log_factorial(j) - log_factorial(n - j) + j * F.ln(p) + (n - j) * F.ln(1 - p))
    odds = p / (1 - p)
    far = _reach(n * p * (1 - p))
    above = _fold(pmf(k), F.least(far, n - k), lambda i: (n - k - i + 1) / (k + i) * odds)
    below = _fold(pmf(k - 1), F.least(far, k - 1), lambda i: (k - i) / (n - k + 1 + i) / odds)
    tail = F.when(k > n * p, F.least(above, F.lit(1.0))).otherwise(F.greatest(1 - below, F.lit(0.0)))
    mean = n * p
    sd = F.sqrt(mean * (1 - p))
    return (F.when(k <= 0, 1.0).when(k > n, 0.0).when(p <= 0, 0.0).when(p >= 1, 1.0)
            .when(n <= exact_limit, tail)
            .when(mean < 1000, poisson_upper(k, mean)).otherwise(normal_upper((k - 0.5 - mean) / sd)))


def wilson(k, n, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Wilson score interval of a share."""
    k, n = _c(k).cast("double"), _c(n).cast("double")
    p, z2 = k / n, z * z
    mid = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return mid - half, mid + half
