"""Time the registered queries; prints one JSON line.

Environment: ``BENCH_SF_DIR`` (tables), ``BENCH_CPUS`` (local cores), ``BENCH_QUERIES``
(comma-separated names, or ``all``; default one or more per operator group). Each query
runs once to warm up and once timed, into the ``noop`` sink, so every row and column is
computed and none is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

from colloquy.plans import PLANS
from colloquy.session import local_session


HEADLINE = (
    "sequence_fit",
    "single_turn_examples",
    "budgeted_examples",
    "merged_assistant_turns",
    "drop_histogram",
    "drop_report",
    "fit_statistics",
    "assistant_only_masks",
    "weighted_masks",
    "bpe_token_masks",
    "padded_batches",
    "weighted_batch_loss",
    "tool_calls_qwen",
    "tool_calls_openai",
    "embedded_tool_calls",
    "chatml_rendering",
    "reward_scores",
    "reward_totals",
    "loop_detection",
    "stop_classification",
    "inference_summary",
    "eos_audit",
    "corpus_summary",
    "text_previews",
    "passage_choice_text",
    "preference_pairs",
    "governance_blocks",
    "comparison_upsert",
    "missing_responses",
    "tool_call_evaluation",
    "metric_rollup",
    "seeded_sample",
    "partition_page",
    "sft_release",
    "stream_metric_rollup",
    "stream_tokenized_rows",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES")
    names = list(PLANS) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    spark = local_session("bench", cpus)
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        began = time.perf_counter()
        PLANS[name].query(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    seconds, failed = {}, {}
    for name in names:
        try:
            run(name)
            seconds[name] = round(run(name), 4)
        except Exception as exc:  # noqa: BLE001 - one failure must not hide the rest
            failed[name] = str(exc)[:300]
        print(f"{name} {seconds.get(name, 'failed')}", file=sys.stderr, flush=True)
    flagship = PLANS["sequence_fit"].query(spark, sf_dir).agg({"tokens": "sum"}).first()[0]
    report = {
        "metric": "total_query_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": cpus,
        "flagship_tokens": flagship,
        "flagship_tokens_per_sec": round(flagship / seconds["sequence_fit"])
        if "sequence_fit" in seconds
        else None,
    }
    if failed:
        report["failed"] = failed
    spark.stop()
    print(json.dumps(report), flush=True)


if __name__ == "__main__":
    main()
