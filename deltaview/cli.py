"""`python -m deltaview.cli plan check PATH`, or `run` with its settings in the environment:

DELTAVIEW_LOG (event files), DELTAVIEW_RELATION (a relation as JSON), DELTAVIEW_PLAN,
DELTAVIEW_CHECKPOINT, DELTAVIEW_STATE (the stream's own checkpoint and kept views), DELTAVIEW_VIEW,
DELTAVIEW_JOIN (fact_key=reference_key) with DELTAVIEW_REFERENCE (the reference's relation), and
DELTAVIEW_FOLLOW=1 to go on until interrupted; the run then ends between two transactions.
"""

from __future__ import annotations

import json
import os
import signal
import sys
import threading

from deltaview.plans.compiler import describe
from deltaview.plans.document import Plan, PlanError

USAGE = "usage: deltaview [run | plan check PATH]"


def plan_check(path: str) -> int:
    try:
        print(describe(Plan.load(path)))
    except (OSError, PlanError) as e:
        print(f"plan error: {e}", file=sys.stderr)
        return 1
    return 0


def run(env: dict[str, str]) -> int:
    from pyspark.sql import SparkSession

    from deltaview.operators.views import JoinSpec, parse_view
    from deltaview.sinks import sinks
    from deltaview.sources import readers
    from deltaview.streaming.engine import Checkpoint, Engine, JoinedView, Runner, view_aggregates

    spark = SparkSession.builder.appName("deltaview").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    readers.register(spark)
    plan = Plan.load(env["DELTAVIEW_PLAN"]) if "DELTAVIEW_PLAN" in env else Plan()
    relation = readers.relation_of(env["DELTAVIEW_RELATION"])
    checkpoint = Checkpoint(env.get("DELTAVIEW_CHECKPOINT", "checkpoint.json"), spark)
    state = env.get("DELTAVIEW_STATE", "stream-state")
    view, references = None, {}
    if "DELTAVIEW_JOIN" in env:
        other = readers.relation_of(env["DELTAVIEW_REFERENCE"])
        view = JoinedView(f"{state}/view", JoinSpec(*env["DELTAVIEW_JOIN"].split("=", 1)))
        references = {f"{other.namespace}.{other.name}": (other, view)}
    elif "DELTAVIEW_VIEW" in env:
        view = sinks.ViewTableSink(f"{state}/view")
    name = f"{relation.namespace}.{relation.name}"
    engine = Engine(name, plan, sinks.build(plan.sink, plan.keys), checkpoint, view)
    runner = Runner({name: (relation, engine)}, checkpoint, references, engine.metrics)
    raw = spark.readStream.format("replication_log").option("path", env["DELTAVIEW_LOG"]).load()
    follow = env.get("DELTAVIEW_FOLLOW") == "1"
    query = runner.start(raw, f"{state}/changes", **({"processingTime": "1 second"} if follow else {"availableNow": True}))
    if follow:
        for s in (signal.SIGINT, signal.SIGTERM):
            signal.signal(s, lambda *_: threading.Thread(target=runner.stop, args=(query,)).start())
    query.awaitTermination()
    if view is not None and "DELTAVIEW_VIEW" in env and (rows := view.read(spark)) is not None:
        for r in view_aggregates(rows, parse_view(env["DELTAVIEW_VIEW"])).toLocalIterator():
            print(json.dumps(r.asDict(), default=str))
    print(engine.metrics.snapshot())
    return 0


def main(args: list[str]) -> int:
    if args[:2] == ["plan", "check"] and len(args) == 3:
        return plan_check(args[2])
    if args in ([], ["run"]):
        return run(dict(os.environ))
    print(USAGE, file=sys.stderr)
    return 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
