"""Bench: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and
print one JSON line.  Each query is executed in full with the ``noop`` sink
(no driver collect); the value is the sum of per-query wall times, including
the jobs a query runs while it is built (counts, cut points, checkpoints).

Before timing, the same queries run once on the smallest scale factor: this
warms the JIT, the generated-code cache and the Python workers.  Its wall time
is reported separately as ``warmup_sec``.  After each query the cache is cleared
and the tables it wrote are deleted, so no query reads what another left."""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quarry.catalog import load_all  # noqa: E402
from quarry.session import build_session, drop_cuts  # noqa: E402

HEADLINE = [
    "ask_pipeline",        # flagship: index pages, answer every user turn (M10)
    "chunk_documents",     # M1 over all documents
    "embed_chunks",        # M1 + M2
    "knn_vectors",         # J5 exact k-NN on the dense table
    "crawl_two_hop",       # P17 two-level crawl
    "extract_links",       # P1
    "html_to_text",        # S2
    "collapse_newlines",   # F3 corpus-wide
    "char_split",          # W2
    "training_blocks",     # M11
    "token_buffer",        # W5
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    # the tables are files of one row group, which a scan cannot split
    spark = build_session(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2, text_partitions=int(cpus) * 2)

    def clean() -> None:
        spark.catalog.clearCache()
        drop_cuts(spark)

    reg = load_all()
    warm_dir = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    t_warm = time.time()
    if warm_dir and os.path.isdir(warm_dir) and os.path.abspath(warm_dir) != os.path.abspath(sf_dir):
        for name in HEADLINE:
            reg[name].build(spark, warm_dir).write.format("noop").mode("overwrite").save()
            clean()
    warmup = round(time.time() - t_warm, 3)
    times = {}
    rows = {}
    for name in HEADLINE:
        t0 = time.time()
        df = reg[name].build(spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        clean()
    # row counts for rows/second (separate pass, not timed)
    for name in ("chunk_documents", "ask_pipeline"):
        rows[name] = reg[name].build(spark, sf_dir).count()
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "rows": rows, "sf": sf, "cpus": int(cpus),
                      "warmup_sec": warmup}))


if __name__ == "__main__":
    main()
