"""Priority, decay, retention and trust as Column expressions. Times are timestamps; ``now`` is passed in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keepstone.functions import constants as K


def seconds(later: Column, earlier: Column) -> Column:
    """Seconds between two timestamps, with fractions."""
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 1e6


def days(later: Column, earlier: Column) -> Column:
    return seconds(later, earlier) / 86400.0


def adjusted_priority(priority: Column, created: Column, accesses: Column, last: Column, feedback: Column, now: Column, half_life: float = 30.0) -> Column:
    """Priority with a half-life, raised by use, recent use and feedback."""
    decay = F.pow(F.lit(0.5), F.greatest(days(now, created), F.lit(0.0)) / half_life) if half_life > 0 else F.lit(1.0)
    recency = F.when(last.isNull(), 1.0).otherwise(1.0 + 0.2 * F.pow(F.lit(0.5), days(now, last) / 7.0))
    return priority * decay * (1.0 + F.log(1.0 + accesses) / 10.0) * recency * (1.0 + 0.1 * F.tanh(F.coalesce(feedback, F.lit(0.0))))


def access_times(created: Column, last: Column, accesses: Column) -> Column:
    """Seconds since the epoch at which a memory is taken to have been used: at most eleven, spread from creation to last use."""
    c, z = F.unix_micros(created.cast("timestamp")) / 1e6, F.unix_micros(last.cast("timestamp")) / 1e6
    n = F.least(accesses - 1, F.lit(10))
    between = F.when((accesses > 2) & (last != created), F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: c + i / (accesses - 1) * (z - c))).otherwise(F.array().cast("array<double>"))
    ends = F.when((accesses > 1) & (last != created), F.array(c, z)).otherwise(F.array(c))
    return F.when(last.isNull(), F.array(c)).otherwise(F.concat(ends, between))


def activation(created: Column, last: Column, accesses: Column, now: Column, rate: float = 0.5) -> Column:
    """Logarithm of the sum of hours since each use, to the power of minus ``rate``."""
    t = F.unix_micros(now.cast("timestamp")) / 1e6
    total = F.aggregate(access_times(created, last, accesses), F.lit(0.0), lambda acc, x: acc + F.pow(F.when(t - x <= 0, F.lit(1.0)).otherwise(t - x) / 3600.0, F.lit(-rate)))
    return F.when(total > 0, F.log(total)).otherwise(-10.0)


def decay_boost(score: Column, strength: Column, weight: float = 0.1) -> Column:
    return score * (1.0 + weight * F.greatest(F.lit(0.0), strength))


def retrieval_probability(last: Column, strength: Column, now: Column) -> Column:
    hours = seconds(now, last) / 3600.0
    stability = F.when(strength > -20, F.exp(strength)).otherwise(1e-9)
    return F.when(hours <= 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.exp(-hours / stability))))


def _by(key: Column, table: dict[str, float], default: float) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def half_life(memory_type: Column, staleness: Column) -> Column:
    return _by(memory_type, K.HALF_LIVES, K.DEFAULT_HALF_LIFE) * _by(staleness, K.STALENESS_FACTORS, 1.0)


def retention_strength(created: Column, accesses: Column, memory_type: Column, staleness: Column, now: Column) -> Column:
    """Strength from 1 to 0: a fifth of the age is forgiven at each use, and each adds a tenth to the half-life up to threefold."""
    n = F.coalesce(accesses, F.lit(0))
    age = F.greatest(days(now, created), F.lit(0.0)) * F.pow(F.lit(0.8), F.least(n, F.lit(30)))
    life = half_life(memory_type, staleness) * F.least(F.lit(3.0), 1.0 + 0.1 * F.least(n, F.lit(20)))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.pow(F.lit(2.0), -age / life)))


def staleness_warning(superseded_by: Column, staleness: Column, updated: Column, now: Column, volatile_days: int = 30, semi_days: int = 90) -> Column:
    age = days(now, updated)
    whole = F.floor(age).cast("string")
    return (
        F.when(superseded_by.isNotNull(), F.concat(F.lit("Superseded by "), superseded_by.cast("string")))
        .when((staleness == "volatile") & (age > volatile_days), F.concat(F.lit("Volatile memory is "), whole, F.lit(f" days old (threshold: {volatile_days}d)")))
        .when((staleness == "semi-stable") & (age > semi_days), F.concat(F.lit("Semi-stable memory is "), whole, F.lit(f" days old (threshold: {semi_days}d)")))
    )


def parse_retention(config: str) -> dict[str, dict[str, int] | int]:
    """A policy such as ``default:90,type:volatile:30,tag:temp:7,ns:scratch:14``; other parts are ignored."""
    out: dict = {"default": 0, "type": {}, "tag": {}, "ns": {}}
    for part in config.split(","):
        p = part.strip().split(":")
        if p[0] == "default" and len(p) == 2:
            out["default"] = int(p[1])
        elif p[0] in ("type", "tag", "ns") and len(p) == 3:
            out[p[0]][p[1]] = int(p[2])
    return out


def retention_days(policy: dict, tags: Column, namespace: Column, memory_type: Column) -> Column:
    """The smallest limit of a tag, else that of the namespace, the type, or the default; 0: kept for ever."""

    def pick(key: Column, table: dict[str, int]) -> Column:
        out = F.lit(None).cast("int")
        for k, v in table.items():
            out = F.when(key == k, v).otherwise(out)
        return out

    by_tag = F.array_min(F.transform(tags, lambda t: pick(t, policy["tag"])))
    return F.coalesce(by_tag, pick(namespace, policy["ns"]), pick(memory_type, policy["type"]), F.lit(policy["default"]))


def trust(successes: Column, failures: Column, prior: float = 0.5) -> Column:
    return (prior * 10 + successes) / (10.0 + successes + failures)


def temporal_similarity(target: Column, found: Column, kind: Column, sigma: float = 30.0) -> Column:
    """How near two dates are; kind: exact, month or year."""
    gap = F.abs(days(target, found))
    same_year = F.year(target) == F.year(found)
    same_month = same_year & (F.month(target) == F.month(found))
    return (
        F.when(kind == "year", F.when(same_year, 0.3).otherwise(0.0))
        .when(kind == "month", F.when(same_month, 0.7).when(same_year, 0.3).otherwise(0.0))
        .when(gap < 0.5, 1.0)
        .when(gap <= 3.5, 0.8)
        .when(same_month, 0.6)
        .when(same_year, 0.3)
        .otherwise(F.exp(-gap / sigma))
    )
