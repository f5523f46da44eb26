"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

HEADLINE = [
    "sem_0_segment_balance", "gen_12_render_orders", "gen_12_render_explicit_null_implicit_binary_1_2",
    "gen_5_pick_no_repeat", "sem_1_extract_orders", "sem_1_extract_implicit_null_implicit_binary_1_1", "sem_2_filter",
    "sem_4_join_inner", "sem_6_join_chain", "sem_7_anti", "sem_9_topk", "sem_13_dedup", "sem_14_intersect",
    "sem_15_bind_subquery", "sem_16_run_steps", "sem_17_run_branches", "post_6_percent_count", "pro_3_field_class",
    "pro_11_document_domain", "txt_5_format_value", "txt_10_predicate_text", "txt_16_split_sentences",
    "det_7_analyze_templates", "val_8_similar_texts", "val_3_segment_counts", "rel_8_inner_join", "rel_15_aggregates",
    "rel_20_ranking", "rel_21_lag_lead", "eva_3_answers_match", "eva_5_metrics_summary", "cst_6_cost_report",
    "qlt_2_sentence_uniqueness", "mod_1_model_map",
]


def main() -> None:
    from textlake.plans import QUERIES
    from textlake.session import local_session
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "textlake-bench")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for key in HEADLINE:
        best = None
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        times[key] = round(best, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
