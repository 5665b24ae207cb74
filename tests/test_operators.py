"""Positions, splits, comparison tables, audits, evaluation and rollups."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from colloquy.operators import audits, comparison, ordering, splits, telemetry, tool_eval


@pytest.mark.parametrize("outlier", [[], [10**15, -(10**14)]])
def test_rows_before_a_position(spark, monkeypatch, outlier):
    """Gaps, crowds and far outliers need further histograms, not larger ones."""
    monkeypatch.setattr(ordering, "MAX_BUCKETS", 16)
    keys = random.Random(1).sample(range(-500, 5_000), 900) + outlier
    df = spark.createDataFrame([(k,) for k in keys] + [(None,)], "k long").repartition(5)
    for position in (0, 1, 13, 899, 900, 5000):
        got = sorted(r.k for r in df.where(ordering.before(df, position, F.col("k"))).collect())
        assert got == sorted(keys)[:position]
    assert df.limit(0).where(ordering.before(df.limit(0), 3, F.col("k"))).count() == 0


def test_no_text_crosses_a_shuffle_for_a_sample(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sample = ordering.sample_train(docs, ["doc_id"], 100)
    assert "Exchange" not in sample._jdf.queryExecution().executedPlan().toString()


def test_shuffled_ordinal_is_a_seeded_permutation(spark):
    df = spark.range(2000).withColumn("s", F.lit("a"))
    got = {r.id: r.ordinal for r in ordering.with_shuffled_ordinal(df, ["id", "s"], 7).collect()}
    digest = lambda i: hashlib.md5(f"{i}|a|7".encode()).hexdigest()
    expected = sorted(range(2000), key=digest)
    assert [i for i, _ in sorted(got.items(), key=lambda x: x[1])] == expected
    again = {r.id: r.ordinal for r in ordering.with_shuffled_ordinal(df.repartition(3), ["id", "s"], 7).collect()}
    assert again == got
    other = {r.id: r.ordinal for r in ordering.with_shuffled_ordinal(df, ["id", "s"], 8).collect()}
    assert other != got


def test_pages_cover_the_table(spark):
    rows = spark.range(25)
    pages = [ordering.page(rows, "id", i, 10).collect() for i in range(3)]
    assert [sorted(r.id for r in p) for p in pages] == [
        list(range(10)), list(range(10, 20)), list(range(20, 25))]
    assert pages[0][0].next_index == 1 and pages[0][0].page_count == 3.5
    small = ordering.page(rows, "id", 0, 26).collect()
    assert len(small) == 25 and {(r.next_index, r.page_count) for r in small} == {(0, 0.0)}
    # A table of exactly the limit is paged.
    assert {r.next_index for r in ordering.page(rows, "id", 0, 25).collect()} == {1}


def test_samples_and_multiples(spark):
    df = spark.range(1000)
    assert ordering.sample_train(df, ["id"], 100).count() == 100
    assert ordering.sample_train(df, ["id"], 5000).count() == 1000
    assert ordering.sample_eval(df, ["id"], 100).count() == 500
    assert ordering.multiple_of(spark.range(11), "id", 4).count() == 8
    assert ordering.first_rows(df, "id", None).count() == 1000
    assert ordering.first_rows(df, "id", 7).count() == 7


@pytest.mark.parametrize("how", ["left_semi", "left_anti"])
def test_heavy_prompts_are_salted_and_whole(spark, monkeypatch, how):
    monkeypatch.setattr(comparison, "HEAVY_ROWS", 20)
    monkeypatch.setattr(comparison, "HEAVY_SHARE", 10)
    texts = ["hot"] * 300 + [f"p{i % 40}" for i in range(100)] + [None] * 5
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "row_id long, prompt string")
    listed = ["hot", "p1", "p2", None, "unknown"]
    prompts = spark.createDataFrame([(t,) for t in listed], "prompt string")
    got = comparison.where_prompt(rows, comparison._digested(prompts), how).collect()
    among = {"hot", "p1", "p2"}
    want = [i for i, t in enumerate(texts) if (t in among) == (how == "left_semi")]
    assert sorted(r.row_id for r in got) == want


def test_percent_split_keeps_units_together(spark):
    df = spark.range(20_000).withColumn("unit", F.col("id") % 5000)
    out = splits.percent_split(df, "unit", 10.0, 42)
    per_unit = out.groupBy("unit").agg(F.countDistinct("split").alias("n"))
    assert per_unit.where("n > 1").count() == 0
    share = out.where("split = 'eval'").count() / 20_000
    assert 0.08 < share < 0.12
    assert splits.percent_split(df, "unit", 0.0, 42).where("split = 'eval'").count() == 0
    assert splits.percent_split(df, "unit", 100.0, 42).where("split = 'train'").count() == 0


def test_split_rules(spark):
    df = spark.range(300).withColumn(
        "split", F.element_at(F.array(*[F.lit(s) for s in ("train", "validation", "test")]),
                              (F.col("id") % 3 + 1).cast("int")))

    def counts(rows):
        return {r["split"]: r["count"] for r in rows.groupBy("split").count().collect()}

    assert counts(splits.resolve_splits(df, ["train", "validation", "test"], ["id"])) == {"train": 100, "test": 100}
    renamed = splits.resolve_splits(df.where("split <> 'test'"), ["train", "validation"], ["id"])
    assert counts(renamed) == {"train": 100, "test": 100}
    single = counts(splits.resolve_splits(df, ["validation"], ["id"]))
    assert sum(single.values()) == 100 and single["train"] > 80
    assert sum(counts(splits.resolve_splits(df, None, ["id"])).values()) == 300
    odd = splits.resolve_splits(df, ["validation", "test"], ["id"])
    assert sum(counts(odd).values()) == 200 and set(counts(odd)) == {"train", "test"}


def plain_upsert(rows, responses):
    """The rules, one response at a time."""
    rows = [dict(r) for r in rows]
    known = {}
    for i, r in enumerate(rows):
        known.setdefault(r["prompt"], i)
    new = []
    for position, (prompt, response, seconds) in enumerate(responses):
        if prompt in known:
            rows[known[prompt]].update(m=response, m_time=seconds, m_timestamp="t")
        else:
            new.append({"row_id": len(rows) + position, "prompt": prompt, "vanilla": None,
                        "m": response, "m_time": seconds, "m_timestamp": "t"})
    return rows + new


@pytest.mark.parametrize("has_column", [True, False])
def test_upsert(spark, has_column):
    rng = random.Random(2)
    rows = [{"row_id": i, "prompt": rng.choice("abcde"), "vanilla": f"v{i}",
             "m": f"old{i}" if has_column else None,
             "m_time": 1.0 if has_column else None, "m_timestamp": "s" if has_column else None}
            for i in range(20)]
    responses = [(rng.choice("bcxyz"), f"r{i}", float(i)) for i in range(12)]
    kind = "row_id long, prompt string, vanilla string, m string, m_time double, m_timestamp string"
    table = spark.createDataFrame([tuple(r.values()) for r in rows], kind)
    if not has_column:
        table = table.drop("m", "m_time", "m_timestamp")
    new = spark.createDataFrame([(i, *r) for i, r in enumerate(responses)],
                                "position long, prompt string, response string, seconds double")
    got = comparison.upsert_responses(table, new, "m", F.lit("t"))
    names = ["row_id", "prompt", "vanilla", "m", "m_time", "m_timestamp"]
    expected = sorted(tuple(r[n] for n in names) for r in plain_upsert(rows, responses))
    assert sorted(map(tuple, got.select(names).collect())) == expected
    lists = spark.createDataFrame([(p,) for p in "abq"], "prompt string")
    missing = comparison.missing_responses(lists, table, "absent")
    assert missing.count() == 3
    assert comparison.shown_rows(got, lists).columns == ["row_id", "prompt", "vanilla", "m"]


def test_upsert_into_empty_table(spark):
    empty = spark.createDataFrame([], "row_id long, prompt string, vanilla string")
    new = spark.createDataFrame([(0, "p", "r", 1.0)], "position long, prompt string, response string, seconds double")
    got = comparison.upsert_responses(empty, new, "vanilla", F.lit("t")).first()
    assert (got.row_id, got.prompt, got.vanilla, got.vanilla_time) == (0, "p", "r", 1.0)


def test_corpus_audit(spark):
    rows = spark.createDataFrame([([1, 2, 9],), ([9, 1, 2, 3],), ([],), ([1, 2],)], "input_ids array<int>")
    audited = audits.audit_sequences(rows, 9)
    s = audits.corpus_summary(audited).first()
    assert (s.samples_analyzed, s.samples_with_final_eos, s.samples_with_issues) == (4, 1, 2)
    assert (s.sequence_length_min, s.sequence_length_max, s.sequence_length_avg) == (2, 4, 3.0)
    assert (s.eos_count_min, s.eos_count_max, s.eos_count_avg) == (0, 1, 0.5)
    assert audits.issue_histogram(audited).first().label == "No EOS token at end of sequence (2x)"
    assert "1/4" in audits.corpus_recommendation(audits.corpus_summary(audited)).first().recommendation
    none = audits.corpus_summary(audited.limit(0)).first()
    assert tuple(none) == (0, 0, 0, 0, 0, 0.0, 0, 0, 0.0)


def test_inference_verdicts(spark):
    loop = "0123456789" * 10
    rows = spark.createDataFrame(
        [("a", loop, "stop"), ("b", "fine", "stop"), ("b", "fine", "eos"), ("c", "cut", "length")],
        "model string, text string, done_reason string")
    got = {r.model: r for r in audits.inference_summary(audits.audit_by_reason(rows)).collect()}
    assert {m: r.verdict for m, r in got.items()} == {"a": "loop", "b": "ok", "c": "not_stopped"}
    by_tokens = audits.audit_by_tokens(
        spark.createDataFrame([("x", [1, 9]), ("x", [1])], "text string, ids array<int>"), 9)
    assert sorted(tuple(r.issues) for r in by_tokens.collect()) == [
        (), ("Generation reached max_new_tokens without EOS",)]


def test_artifact_choice_and_content(spark):
    rows = [("r1", "m-Q8_0.gguf", 0), ("r1", "m-q4_k_m.gguf", 1), ("r1", "m-Q4_K_M-2.gguf", 2),
            ("r2", "f16.gguf", 1), ("r2", "other.gguf", 0), ("r2", "Q4_K_M.bin", 2), ("r3", "x.txt", 0)]
    df = spark.createDataFrame(rows, "repo string, file string, position int")
    assert {r.repo: r.selected_file for r in audits.preferred_artifact(df).collect()} == {
        "r1": "m-q4_k_m.gguf", "r2": "other.gguf"}
    listing = {"a": ["adapter_config.json"], "f": ["config.json", "model.safetensors"],
               "m": ["adapter_model.bin", "config.json", "pytorch_model.bin"], "u": ["config.json"]}
    df = spark.createDataFrame([(k, f) for k, v in listing.items() for f in v], "repo string, file string")
    assert {r.repo: r.content for r in audits.repository_content(df).collect()} == {
        "a": "adapter", "f": "full", "m": "mixed", "u": "unknown"}


def test_tool_call_evaluation(spark):
    kind = "example_id int, call_index int, name string, arguments string"
    expected = spark.createDataFrame(
        [(1, 0, "f", '{"a": 1, "b": "X  y"}', "s1", "P1"), (2, 0, "f", '{"a": 1}', "s1", "P2"),
         (3, 0, "f", "{}", "s2", "P1"), (4, 0, "f", '{"a": null}', "s2", "P2")],
        kind + ", scenario_type string, policy_class string")
    predicted = spark.createDataFrame(
        [(1, 0, "f", '{"b":"x y","a":"1.0"}'), (2, 0, "g", '{"a":1}'), (4, 0, "f", '{"a": null}')], kind)
    compared = tool_eval.compare_calls(tool_eval.pair_calls(expected, predicted))
    got = {r.example_id: (r.decision_match, r.strict_match, r.relaxed_match, r.matching_keys)
           for r in compared.collect()}
    assert got == {1: (True, False, True, 2), 2: (False, False, False, 1),
                   3: (False, False, False, 0), 4: (True, True, True, 1)}
    report = tool_eval.evaluation_report(compared).collect()
    overall = next(r for r in report if r.grouping == 3)
    assert (overall.calls, overall.decision_accuracy, overall.strict_match) == (4, 0.5, 0.25)
    assert overall.argument_precision == 1.0
    assert len(report) == 4 + 2 + 2 + 1


def test_rollups(spark):
    rows = spark.sql("""SELECT * FROM VALUES ('r', TIMESTAMP'2024-01-01 00:00:00', 'cpu', 1.0D),
      ('r', TIMESTAMP'2024-01-01 00:00:30', 'cpu', 3.0D), ('r', TIMESTAMP'2024-01-01 00:00:10', 'gpu', NULL)
      AS t(run_id, ts, key, value)""")
    got = {r.metric: r.value for r in telemetry.long_metrics(telemetry.metric_rollup(rows)).collect()}
    assert got == {"cpu_avg": 2.0, "cpu_peak": 3.0, "gpu_avg": 0.0, "gpu_peak": 0.0}
    run = telemetry.run_rollup(rows).first()
    assert (run.telemetry_samples, run.run_wall_time_sec) == (2, 30.0)
