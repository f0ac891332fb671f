"""Time the headline queries; prints one JSON line."""

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from paperloom.plans.catalog import QUERIES  # noqa: E402
from paperloom.session import build_session  # noqa: E402

HEADLINE = [
    "route_decision", "document_proto_topk", "document_routes", "group_candidates_merged", "group_shortlist", "global_chunk_topk",
    "scoped_chunk_topk", "pruned_topk", "retrieve",
    "struct_type", "window_chunks", "recursive_chunks", "embed_terms", "segment_split",
    "kmeans_groups", "group_prototypes", "group_medoid",
    "replace_by_document", "cascade_regroup", "upsert_latest", "stored_state", "regroup_repair",
    "normalize_github", "normalize_jira", "html_text", "change_gate", "change_gate_batches", "debounce_sessions", "citation_map",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]", "paperloom-bench",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": os.environ.get("BENCH_CHECKPOINT_DIR") or tempfile.mkdtemp(prefix="run-"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    # start the JVM and the Python workers before the clock runs
    QUERIES["embed_terms"](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        started = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - started, 3)
    spark.stop()
    scale = Path(folder).name.removeprefix("sf")
    print(json.dumps({
        "metric": "headline queries, total time", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": scale,
    }))


if __name__ == "__main__":
    main()
