"""Evidence, confidence, ageing and retention as column expressions; every clock is an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def posterior_mean(successes: Column, failures: Column) -> Column:
    """Mean of the Beta posterior on a uniform prior; 0 without evidence."""
    n = successes + failures
    return F.when(n > 0, (successes + 1.0) / (n + 2.0)).otherwise(0.0)


def wilson(successes: Column, failures: Column, z: float = 1.96) -> Column:
    """Lower end of Wilson's 95 % interval; 0 without trials."""
    n = successes + failures
    p, zz = successes / n, z * z
    low = (p + zz / (n * 2.0) - F.sqrt((p * (F.lit(1.0) - p) + zz / (n * 4.0)) / n) * z) / (zz / n + 1.0)
    return F.when(n > 0, F.greatest(low, F.lit(0.0))).otherwise(0.0)


def age_days(created_ms: Column, now_ms: int) -> Column:
    return F.greatest(F.floor((F.lit(now_ms) - created_ms) / DAY_MS), F.lit(0)).cast("double")


def age_factor(days: Column) -> Column:
    return F.lit(1.0) / (days / 90.0 + 1.0)


def confidence(similarity: Column, age: Column, low: Column, feedback: Column, task: Column, drift: Column) -> Column:
    """Similarity that fades with age, evidence, feedback and task confirmation, damped by drift; within 0 and 1."""
    zero = F.lit(0.0)
    raw = similarity * age + low + F.greatest(feedback, zero) * 0.2 + F.greatest(task, zero) + age * 0.05 * (F.lit(1.0) - similarity)
    return F.least(F.greatest(raw * (F.lit(1.0) - drift * 0.5), zero), F.lit(1.0))


def ttl_days(classification: Column, reviews: Column, base: tuple[int, int, int] = (0, 365, 30), growth: int = 50) -> Column:
    """Days until a note expires: a base by class, growing by ``growth`` % a review; null where it never does."""
    days = F.when(classification == "foundational", base[0]).when(classification == "observational", base[2]).otherwise(base[1])
    more = F.floor(days * growth * reviews / 100)
    return F.when(days > 0, (days + more).cast("long"))


def retention(elapsed_days: Column, ttl: Column) -> Column:
    """Halves with every time-to-live; 1 where nothing expires."""
    return F.when(ttl.isNull(), 1.0).otherwise(F.pow(F.lit(0.5), elapsed_days / ttl))


def idf(n: Column, df: Column) -> Column:
    df = F.coalesce(df, F.lit(0))
    return F.log1p((n - df + 0.5) / (df + 0.5))


# How much a note's type weighs in ranking.
TYPE_WEIGHT = {"decision": 1.20, "error": 1.15, "fact": 1.10, "def": 1.05, "risk": 1.05, "task": 1.00, "question": 1.00, "snippet": 0.95, "link": 0.90, "meta": 0.90, "epic": 0.70}


def type_weight(kind: Column) -> Column:
    out = F.when(F.lit(False), 0.0)
    for k, w in TYPE_WEIGHT.items():
        out = out.when(kind == k, w)
    return out.otherwise(1.0)
