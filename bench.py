"""Headline queries timed on one machine; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from corrobora.plans import catalog  # noqa: E402
from corrobora.session import build_session  # noqa: E402

HEADLINE = [
    "snk1_contract", "jn8_window", "jn14_prior_claims", "set3_upsert", "rk2_risk_score", "wn1_rank_evidence",
    "wn4_interleaved_topk", "wn6_top_tokens", "ag11_keywords", "ag12_term_vectors", "htm1_article_text",
    "dt1_flexible_date", "str4_redact", "flagship_top_evidence", "sc1_relevance", "sim1_cosine", "jn5_phonetic",
    "jn7_names", "jn7_substring", "cl1_stories",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": str(cpus), "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    # One small scan starts the engine before the clock does.
    spark.read.parquet(f"{folder}/nation.parquet").count()
    times = {}
    for name in HEADLINE:
        start = time.time()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
