"""Measured skew: per-task shuffle reads from Spark's event log."""

import json
import os
import subprocess
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))


@pytest.fixture(scope="module")
def probe(tmp_path_factory):
    out = subprocess.run([sys.executable, os.path.join(HERE, "skew_probe.py"), str(tmp_path_factory.mktemp("events"))],
                         capture_output=True, text=True, timeout=900, check=True)
    return json.loads(out.stdout.strip().splitlines()[-1])


def test_hot_phone_is_trimmed_before_the_shuffle(probe):
    hot = probe["hot_calls"]
    most = probe["max_task_shuffle_records"]
    # without the map-side limit one task reads all of the hot phone's calls
    assert most["control"] >= hot
    # with it, no task of either quota rule comes close
    assert most["arrival"] < 0.5 * hot and most["batch"] < 0.5 * hot


@pytest.mark.parametrize("rule", ["arrival", "batch"])
def test_a_large_quota_keeps_tasks_even(probe, rule):
    """A quota of 1000 over 64 map tasks: no task has over twice the mean."""
    large, ranked = probe["large"][f"large_{rule}"], probe["large"][f"ranked_{rule}"]
    assert large["busiest"] <= 2 * large["mean"]
    assert ranked["busiest"] > 3 * ranked["mean"]  # what ranking does
    assert large["accepted"] == ranked["accepted"]
