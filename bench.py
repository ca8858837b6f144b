"""Time the headline queries; one JSON line on standard output."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from urlsieve import registry  # noqa: E402
from urlsieve.session import local_session  # noqa: E402

HEADLINE = [
    "url_tokens", "token_df", "risk_dict_adaptive", "doc_risk_lexicon", "ev_structure", "ev_url_score", "decide_fused",
    "page_signals", "text_keyword_hits", "feat_lexical", "feat_tfidf", "similar_cases", "decide_hybrid", "model_margin",
    "model_grad_step", "dict_versions", "prog_batch_metrics", "xai_token_scores", "rate_rolling", "rate_admission",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    registry.load_all()
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "*"))
    spark.sparkContext.setLogLevel("ERROR")
    run = lambda name: registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    run("ev_structure")  # starts the JVM's and Python's machinery
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        run(name)
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
