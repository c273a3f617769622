"""Column expressions over logits, labels and training steps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairloom.settings import FIXED_RATE, MODEL_WIDTH, WARMUP_STEPS


def argmax(logits: Column) -> Column:
    """Index of the largest logit, the first one on ties."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def cross_entropy(label: Column, logits: Column) -> Column:
    """``logsumexp(logits) - logits[label]``, shifted by the largest logit. A label without a logit is an error."""
    z = logits.cast("array<double>")
    top = F.array_max(z)
    total = F.aggregate(z, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
    outside = (label < 0) | (label >= F.size(z))
    message = F.concat(F.lit("label "), label.cast("string"), F.lit(" has no logit"))
    own = F.when(outside, F.raise_error(message).cast("double")).otherwise(F.get(z, label))
    return top + F.ln(total) - own


def scheduled_rate(step: Column, width: int = MODEL_WIDTH, warmup: int = WARMUP_STEPS) -> Column:
    """Inverse-square-root rate with linear warm-up; 0 at step 0."""
    s = step.cast("double")
    return F.lit(float(width) ** -0.5) * F.least(F.power(s, F.lit(-0.5)), s * F.lit(float(warmup) ** -1.5))


def learning_rate(step: Column, fixed: bool = False, rate: float = FIXED_RATE, **schedule) -> Column:
    return F.lit(rate) if fixed else scheduled_rate(step, **schedule)


def uniform(*parts: Column) -> Column:
    """Repeatable number in (0, 1) that depends on the given values only, not on partitioning."""
    digits = F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(16**12))


def gumbel(u: Column) -> Column:
    return -F.ln(-F.ln(u))


def rounded(x: Column, places: int = 6) -> Column:
    """``F.round`` of a double, half up by its decimal digits, without going through them except near a half."""
    scaled = x * F.lit(10.0**places)
    plain = (F.abs(scaled) < 1e9) & (F.abs(scaled - F.floor(scaled) - 0.5) > 1e-4)
    return F.when(plain, F.rint(scaled) / F.lit(10.0**places) + F.lit(0.0)).otherwise(F.round(x, places))
