"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, (ROOT, os.environ.get("PYTHONPATH"))))

from brightmill.plans import registry  # noqa: E402
from brightmill.session import build_session  # noqa: E402

HEADLINE = (
    "a3_top_users_by_cost", "a8_multi_window_usage", "a10_top_failure_reasons", "a11_failed_providers", "a12_failures_by_model", "a14_usage_by_day", "a19_credits_by_day",
    "a21_global_cost_stats", "j2_plan_features", "j4_u3_semi_anti", "j12_conversation_messages", "k3_upsert", "o3_keyset_page", "t1_rate_limiter", "t3_key_limits", "t4_circuit_breaker",
    "w2_citation_ids", "w7_failure_runs", "x1_query_complexity", "x12_x14_html_to_text", "x16_x17_urls",
)


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8, **{"spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    found = {name: registry.queries()[name] for name in HEADLINE}
    try:
        from brightmill.llm import queries as corpus

        found |= corpus.queries()
    except ImportError:
        pass
    seconds = {}
    for name, run in found.items():
        times = []
        for _ in range(2 if not name.startswith("op") else 1):
            start = time.perf_counter()
            run(spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(min(times), 3)
    print(json.dumps({"metric": "total query time", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": folder.rsplit("sf", 1)[-1].rstrip("/")}))


if __name__ == "__main__":
    main()
