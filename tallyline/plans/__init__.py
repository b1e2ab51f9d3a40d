"""Wired query plans over the data folder, and their SQL oracles."""

from tallyline.plans.queries import QUERIES, QueryParams
from tallyline.plans.oracle import ORACLE_SQL
from tallyline.plans.replays import REPLAY_SQL, REPLAYS

__all__ = ["QUERIES", "QueryParams", "ORACLE_SQL", "REPLAYS", "REPLAY_SQL"]
