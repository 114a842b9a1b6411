"""Print the physical plans of the key operators (``explain("formatted")``).

usage: python tools/explain_plans.py [sf_dir]

What to look for: the data pass is Scan -> MapInArrow -> partial
HashAggregate -> Exchange(q keys) -> final HashAggregate (no raw-point
shuffle); snapshot reads carry PartitionFilters on ``tick``; the pair
lookup attaches one broadcast row; scans read only the needed columns.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tiltframe.operators import snapshots as sn  # noqa: E402
from tiltframe.operators.assign import collect_view  # noqa: E402
from tiltframe.operators.features import assign_and_summarize, cf_merge_partials, empty_state  # noqa: E402
from tiltframe.plans import queries as Q  # noqa: E402
from tiltframe.plans.common import seeds, user_snapshot_at  # noqa: E402
from tiltframe.session import local_session, new_run_dir  # noqa: E402
from tiltframe.sources.tables import lineitem_points  # noqa: E402


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session()
    pts = lineitem_points(spark, sf)
    view = collect_view(empty_state(spark, seeds(pts, 50), 4, "center"))
    fused = assign_and_summarize(pts, view, None)
    print("=== online data pass (ON6 + ON8)")
    cf_merge_partials(fused.where("kind = 0").select("slot", "n", "cf1x", "cf2x", "cf1t", "cf2t"), 4).explain("formatted")

    path = new_run_dir(spark, "explain")
    live = Q._daily_live(spark, sf)
    user_snapshot_at(spark, sf, None, live).write.partitionBy("tick").parquet(path)
    snaps = sn.read_snapshots(spark, path)
    print("=== snapshot scan (SRC6)")
    sn.snapshot_at(snaps, 28).explain("formatted")
    print("=== snapshot pair (SN4)")
    sn.snapshot_pairs(Q._requests(spark), sn.live_ticks(snaps)).explain("formatted")
    print("=== horizon micro-clusters for all requests (SN4-SN6)")
    sn.horizon_clusters(snaps, Q._requests(spark)).explain("formatted")


if __name__ == "__main__":
    main()
