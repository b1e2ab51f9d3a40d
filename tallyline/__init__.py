"""tallyline: phone-in vote quotas, leaderboards and throughput on PySpark.

Every operator is a ``DataFrame -> DataFrame`` transformation built from
Spark SQL column expressions, so Catalyst can push filters and prune
columns through it; the streaming forms live in :mod:`tallyline.streaming`.
"""

from tallyline.session import build_session, checkpoint_root

__all__ = ["build_session", "checkpoint_root"]
