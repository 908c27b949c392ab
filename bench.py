"""Time the headline queries: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8)
the local cores. Every query runs whole and its result is written to a no-op sink.
"""

from __future__ import annotations

import json
import os
import time

from cratewise.catalog import QUERIES
from cratewise.session import build_session

HEADLINE = [
    "similar_to_one", "knn_topk", "misread_audit", "match_centroids", "label_candidates", "weighted_centroid",
    "track_classes", "identity_chain", "blend_adjust", "keystone_profile", "subgenre_profile", "exclusive_deciles",
    "salience", "hysteresis", "majority_smooth", "absorb_short_runs", "envelope_bins", "resample",
    "facet_search", "facet_bounds", "harmonic_counts", "playlist_order", "tag_names",
    "label_union", "contested_order", "credit_split", "dedupe_by_hash", "strip_html", "collection_tracks", "head_relabel",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "cratewise-bench", master=f"local[{cpus}]", spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="16g", spark__ui__enabled="false",
    )
    spark.sparkContext.setLogLevel("OFF")
    QUERIES["similar_to_one"](spark, folder).collect()  # start the Python workers
    times = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
