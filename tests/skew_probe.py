"""Run both quota rules on input where one phone has a third of all calls and
report, from Spark's event log, the most shuffle records any task read: with a small
quota, and with a quota of 1000 over 64 map tasks (cut off by counts, and ranked).

Usage: python tests/skew_probe.py EVENT_LOG_DIR  (prints one JSON line)
"""

import glob
import json
import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from pyspark.sql import functions as F  # noqa: E402

from tallyline.operators import quota  # noqa: E402
from tallyline.session import build_session  # noqa: E402
from tallyline.sources.calls import CallViewSpec, call_view  # noqa: E402
from tallyline.sources.tables import read_table  # noqa: E402

HOT = 9_999_999_999


def main():
    log_dir = sys.argv[1]
    spark = build_session("local[4]", 8, app_name="skew-probe", extra={
        "spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir,
        "spark.eventLog.compress": "false", "spark.eventLog.rolling.enabled": "false",
        "spark.sql.adaptive.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    view = call_view(read_table(spark, "/root/testdata/sf0.01", "events"))
    # eight map tasks, as a multi-split scan would give
    hot = (view.withColumn("phone_number", F.when(F.col("vote_id") % 3 == 0, F.lit(HOT))
                           .otherwise(F.col("phone_number")))
           .repartition(8))
    hot_calls = hot.where(F.col("phone_number") == HOT).count()
    runs = {}
    for name, df in (("arrival", quota.arrival_quota(hot, 20, 6)),
                     ("batch", quota.batch_quota(hot, 20, 6))):
        spark.sparkContext.setJobGroup(name, name)
        df.write.format("noop").mode("overwrite").save()
    # control: the same query with the map-side group limit switched off
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "-1")
    spark.sparkContext.setJobGroup("control", "control")
    quota.arrival_quota(hot, 20, 6).write.format("noop").mode("overwrite").save()
    spark.sparkContext.setJobGroup("other", "other")
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "100000")
    # sf0.1: one call in three is the hot phone's, in every batch; batches of a minute
    spec = CallViewSpec(batch_seconds=60)
    view = call_view(read_table(spark, "/root/testdata/sf0.1", "events"), spec)
    hot = (view.withColumn("phone_number", F.when(F.col("vote_id") % 3 == 0, F.lit(HOT))
                           .otherwise(F.col("phone_number"))).repartition(64))
    accepted = {}
    for name, quota.RANKED_QUOTA in (("large", 128), ("ranked", 1 << 30)):
        for rule, apply in (("arrival", quota.arrival_quota), ("batch", quota.batch_quota)):
            spark.sparkContext.setJobGroup("other", "other")
            accepted[f"{name}_{rule}"] = apply(hot, 1000, 6).agg(F.count(F.lit(1)), F.sum("vote_id")).first()
            spark.sparkContext.setJobGroup(f"{name}_{rule}", name)
            apply(hot, 1000, 6).write.format("noop").mode("overwrite").save()
    spark.stop()
    [log] = glob.glob(os.path.join(log_dir, "*"))
    group_of_job, stage_job = {}, {}
    stage_max, stage_sum = {}, {}
    with open(log) as fh:
        for line in fh:
            ev = json.loads(line)
            kind = ev.get("Event")
            if kind == "SparkListenerJobStart":
                group = (ev.get("Properties") or {}).get("spark.jobGroup.id")
                for sid in ev.get("Stage IDs", []):
                    stage_job[sid] = group
            elif kind == "SparkListenerTaskEnd":
                metrics = ev.get("Task Metrics") or {}
                read = (metrics.get("Shuffle Read Metrics") or {}).get("Total Records Read", 0)
                sid = ev["Stage ID"]
                stage_max[sid] = max(stage_max.get(sid, 0), read)
                stage_sum[sid] = stage_sum.get(sid, 0) + read
    # the last stage of each job reads the shuffle by phone (the window input)
    for group in ("arrival", "batch", "control"):
        stages = sorted(sid for sid, g in stage_job.items() if g == group and sid in stage_max)
        runs[group] = stage_max[stages[-1]] if stages else None
    large = {}
    for group in accepted:
        own = [sid for sid, g in stage_job.items() if g == group and stage_sum.get(sid)]
        # the busiest task of any stage, against the mean task (of eight) of the largest one
        large[group] = {"busiest": max(stage_max[s] for s in own), "mean": max(stage_sum[s] for s in own) / 8,
                        "accepted": list(accepted[group])}
    print(json.dumps({"large": large, "hot_calls": hot_calls, "max_task_shuffle_records": runs,
                      "per_stage": {str(k): v for k, v in sorted(stage_max.items())}}))


if __name__ == "__main__":
    main()
