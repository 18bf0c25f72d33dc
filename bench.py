"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tracelab.plans import QUERIES  # noqa: E402
from tracelab.session import build_session  # noqa: E402

HEADLINE = [
    "fc_distribution", "al_correlations", "mc_validate", "mc_design_variance", "sg_zero_signal",
    "vd_combo_report", "vd_filter_report", "extract_answer_v5", "extract_rule_agreement", "eval_rescore_diff",
    "score_by_protocol", "pr_value_grounding", "pr_anchored_grounding", "rw_conditional_v2", "rw_multiplicative",
    "tr_segment_steps", "cl_jaccard", "cl_perception_distribution", "qa_core", "qa_dispatch",
    "cp_contamination", "cp_contamination_text", "cp_stratified_sample", "ft_artifact_audit", "st_incremental_scoring",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    # small partitions: the work per row is heavy (regular expressions), the rows are few
    spark = build_session(
        f"local[{cpus}]",
        app="bench",
        spark__sql__shuffle__partitions=cpus,
        spark__sql__adaptive__coalescePartitions__minPartitionSize="256k",
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "16g"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor threads before timing
    names = sys.argv[1:] or HEADLINE
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
