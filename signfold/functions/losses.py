"""Row and aggregate forms of the losses and schedules over logits columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .codec import _col


def log_sigmoid(x: Column) -> Column:
    """Stable for any x."""
    return F.least(x, F.lit(0.0)) - F.log1p(F.exp(-F.abs(x)))


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def sigmoid_slope(x: Column) -> Column:
    """sigma(x) * sigma(-x)."""
    return F.exp(log_sigmoid(x) + log_sigmoid(-x))


def log_add_exp(a: Column, b: Column) -> Column:
    """Minus infinity counts as no probability; two of them give minus infinity."""
    top = F.greatest(a, b)
    return F.when(top == float("-inf"), top).otherwise(top + F.log1p(F.exp(-F.abs(a - b))))


def log_sum_exp(values: Column | str) -> Column:
    """Of an array of doubles; a largest value of minus infinity counts as 0."""
    values = _col(values)
    top = F.array_max(values)
    top = F.when(top == float("-inf"), F.lit(0.0)).otherwise(top)
    return top + F.log(F.aggregate(values, F.lit(0.0), lambda acc, x: acc + F.exp(x - top)))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def huber(x: Column | str, slope: float, branch: float) -> Column:
    """c x**2 within the branch point, linear with the given slope beyond it."""
    x, c = _col(x), slope / (2 * branch)
    return F.when(F.abs(x) < branch, F.lit(c) * x * x).otherwise(F.lit(slope) * F.abs(x) + F.lit(c * branch**2 - slope * branch))


def huber_slope(x: Column | str, slope: float, branch: float) -> Column:
    x = _col(x)
    return F.when(F.abs(x) < branch, F.lit(slope / branch) * x).otherwise(F.lit(slope) * F.signum(x))


def bernoulli_equality(a: Column | str, b: Column | str) -> tuple[Column, Column]:
    """Arrays of log P(bits differ) and log P(bits agree) of two Bernoulli vectors given by logits."""

    def parts(x: Column, y: Column, agree: bool) -> Column:
        s = 1 if agree else -1
        return log_add_exp(log_sigmoid(x) + log_sigmoid(s * y), log_sigmoid(-x) + log_sigmoid(-s * y))

    def bits(agree: bool) -> Column:
        return F.zip_with(_col(a), _col(b), lambda x, y: parts(x.cast("double"), y.cast("double"), agree))

    return bits(False), bits(True)


def hamming_loss(a: Column | str, b: Column | str, weight: float = 1.0) -> Column:
    """-weight * sum of log P(bits agree), for one pair; a batch's loss is its average."""
    return F.lit(-weight) * total(bernoulli_equality(a, b)[1])


def hamming_loss_slope(a: Column | str, b: Column | str) -> Column:
    """Gradient of -log P(bits agree) by the first logits: sigma(x)sigma(-x) (1 - 2 sigma(y)) / P(agree)."""

    def one(x: Column, y: Column) -> Column:
        p, q = F.exp(log_sigmoid(x)), F.exp(log_sigmoid(y))
        return -sigmoid_slope(x) * (2 * q - 1) / (p * q + (1 - p) * (1 - q))

    return F.zip_with(_col(a), _col(b), lambda x, y: one(x.cast("double"), y.cast("double")))


def tanh_dot(a: Column | str, b: Column | str, beta: float = 1.0) -> Column:
    return total(F.zip_with(_col(a), _col(b), lambda x, y: F.tanh(F.lit(beta) * x.cast("double")) * F.tanh(F.lit(beta) * y.cast("double"))))


def pair_loss(dot: Column | str, similar: Column | str, alpha: float) -> Column:
    """softplus(alpha dot) - similar * alpha * dot; similar is 1 or 0 (all ones or zeros give the one-sided forms)."""
    x = F.lit(alpha) * _col(dot)
    return softplus(x) - _col(similar) * x


def kl_to_bernoulli(logits: Column | str, p: float) -> Column:
    """KL divergence of sigma(logits) to Bernoulli(p), summed over bits."""
    from math import log

    def one(x: Column) -> Column:
        x = x.cast("double")
        up, down = log_sigmoid(x), log_sigmoid(-x)
        return F.exp(up) * (up - F.lit(log(p))) + F.exp(down) * (down - F.lit(log(1 - p)))

    return total(F.transform(_col(logits), one))


def straight_sign(x: Column | str) -> Column:
    return F.signum(_col(x))


def heaviside(x: Column | str) -> Column:
    """1 at 0 and above, unlike binarize."""
    return F.when(_col(x) >= 0, F.lit(1)).otherwise(F.lit(0))


def polynomial_schedule(step: Column | str, init: float, gamma: float, power: float, size: int) -> Column:
    """init * (1 + gamma * the last multiple of size up to the step) ** power."""
    step = _col(step)
    return F.lit(float(init)) * F.pow(F.lit(1.0) + F.lit(float(gamma)) * (step - F.pmod(step, F.lit(size))), F.lit(float(power)))


def clipped(x: Column | str, most: float) -> Column:
    return F.least(F.greatest(_col(x), F.lit(-most)), F.lit(most))


def clip_ratio(x: Column | str, most: float) -> Column:
    """Aggregate: share of values beyond +-most."""
    return F.avg((F.abs(_col(x)) > F.lit(most)).cast("double"))


def permuted(values: Column | str, order: list[int]) -> Column:
    values = _col(values)
    return F.array(*[F.element_at(values, i + 1) for i in order])


def inverse_permutation(order: list[int]) -> list[int]:
    out = [0] * len(order)
    for i, at in enumerate(order):
        out[at] = i
    return out
