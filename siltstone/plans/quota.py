"""Call quotas from a compact text, shared out to partitions.

A quota names how many calls run at a time and, by keys, at what rate: ``8|rpm:30|tps:400|burst:2``.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

#: Keys by what they limit, with the seconds of their unit of time.
RATES = {"rps": ("calls_per_second", 1), "rpm": ("calls_per_second", 60), "tps": ("tokens_per_second", 1), "tpm": ("tokens_per_second", 60)}
PART = re.compile(r"(?P<concurrency>\d+)|(?P<key>[a-z]+):(?P<value>\d+(?:\.\d+)?)")


@dataclass(frozen=True)
class Quota:
    concurrency: int
    calls_per_second: float | None = None
    tokens_per_second: float | None = None
    burst: float = 1.0

    def share(self, partitions: int) -> Quota:
        """What one of so many partitions may use, for a cluster has no common limiter."""
        part = lambda x: None if x is None else x / partitions
        return Quota(max(1, self.concurrency // partitions), part(self.calls_per_second), part(self.tokens_per_second), self.burst)


def parse_quota(text: int | str) -> Quota:
    """The quota that a text names; ValueError says what it lacks or says twice."""
    parts = [PART.fullmatch(part) for part in str(text).split("|")]
    if None in parts:
        raise ValueError(f"{text!r} is no quota: parts are a number of calls and key:number")
    numbers = [int(p["concurrency"]) for p in parts if p["concurrency"]]
    keyed = [(p["key"], float(p["value"])) for p in parts if p["key"]]
    limits = Counter(RATES[key][0] if key in RATES else key for key, _ in keyed)
    faults = {
        "a number of calls at a time is missing": not numbers,
        "the number of calls must be positive": 0 in numbers,
        f"keys are {', '.join(sorted([*RATES, 'burst']))}": bool(limits.keys() - {"calls_per_second", "tokens_per_second", "burst"}),
        "a rate by the second and one by the minute exclude one another": any(n > 1 for n in limits.values()),
    }
    for fault, found in faults.items():
        if found:
            raise ValueError(f"{text!r}: {fault}")
    given = {RATES[key][0]: value / RATES[key][1] for key, value in keyed if key in RATES}
    return Quota(numbers[-1], burst=dict(keyed).get("burst", 1.0), **given)
