"""Brute-force reference model of the vote semantics, for small fixtures only.

Plain loops over Python lists, written straight from the rules, so the
Spark operators can be checked against it.
"""

from __future__ import annotations

from collections import Counter, defaultdict


def batch_quota(calls, max_votes, num_contestants):
    """Variant A: update each phone's count with the whole batch, then accept
    calls whose phone's count is within the quota and contestant valid."""
    counts = Counter()
    accepted = []
    for b in sorted({c["batch_id"] for c in calls}):
        in_batch = [c for c in calls if c["batch_id"] == b]
        for c in in_batch:
            counts[c["phone_number"]] += 1
        for c in in_batch:
            if counts[c["phone_number"]] <= max_votes and c["contestant_number"] <= num_contestants:
                accepted.append(c["vote_id"])
    return sorted(accepted)


def arrival_quota(calls, max_votes, num_contestants, order=("batch_id", "vote_id")):
    """Variant B: first ``max_votes`` calls per phone in arrival order spend the
    quota; then the contestant check."""
    used = Counter()
    accepted = []
    for c in sorted(calls, key=lambda c: tuple(c[k] for k in order)):
        if used[c["phone_number"]] >= max_votes:
            continue
        used[c["phone_number"]] += 1
        if c["contestant_number"] <= num_contestants:
            accepted.append(c["vote_id"])
    return sorted(accepted)


def running_counts(calls):
    """vote_id -> phone's count after the call's batch."""
    per = defaultdict(Counter)
    for c in calls:
        per[c["phone_number"]][c["batch_id"]] += 1
    out = {}
    for c in calls:
        batches = per[c["phone_number"]]
        out[c["vote_id"]] = sum(n for b, n in batches.items() if b <= c["batch_id"])
    return out


def totals(calls, accepted_ids):
    ids = set(accepted_ids)
    return Counter(c["contestant_number"] for c in calls if c["vote_id"] in ids)


def window_counts(calls, accepted_ids, size_batches):
    """(first batch of window, contestant) -> n, windows of ``size_batches``
    batches sliding by one batch."""
    ids = set(accepted_ids)
    out = Counter()
    for c in calls:
        if c["vote_id"] in ids:
            for first in range(c["batch_id"] - size_batches + 1, c["batch_id"] + 1):
                out[(first, c["contestant_number"])] += 1
    return out


def java_space_split(line):
    """Single-space split, trailing empty strings removed."""
    parts = line.split(" ")
    if line == "":
        return [""]
    while parts and parts[-1] == "":
        parts.pop()
    return parts


def rate_summary(samples, trailing=4):
    kept = [v for v in samples[: max(len(samples) - trailing, 0)] if v != 0]
    n = len(kept)
    if n == 0:
        return n, None, None, None, None
    mean = sum(kept) / n
    var = sum((v - mean) ** 2 for v in kept) / (n - 1) if n > 1 else None
    return n, max(kept), min(kept), mean, (var ** 0.5 if var is not None else None)
