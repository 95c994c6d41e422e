"""Plan shape and skew: filters and column pruning reach the scan, and a
conversation holding a third of all rows is ranked exactly."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tagwright.operators.responses import responses_from_flat


def test_hot_conversation_response_indices(spark):
    rows = []
    # conversation 0 holds a third of all messages
    for t in range(600):
        rows.append((0, t, "user" if t % 3 == 0 else "assistant", f"msg {t}" if t % 7 else "   "))
    for c in range(1, 121):
        for t in range(10):
            rows.append((c, t, ["system", "user", "assistant"][t % 3], f"c{c} t{t}"))
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = responses_from_flat(conv, "train", block_turns=16)
    kept = conv.where((F.col("role") == "assistant") & (F.trim("text") != ""))
    want = kept.select(
        F.col("conv_id").alias("source_row"),
        (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).alias("response_index"),
        F.col("text").alias("assistant_output"),
    )
    prompts = conv.where(F.col("role") == "user").groupBy("conv_id").agg(F.min_by("text", "turn").alias("prompt"))
    want = want.join(prompts.withColumnRenamed("conv_id", "source_row"), "source_row", "left")
    a = sorted(map(tuple, got.select("source_row", "response_index", "assistant_output", "prompt").collect()))
    b = sorted(map(tuple, want.select("source_row", "response_index", "assistant_output", F.coalesce("prompt", F.lit("")).alias("prompt")).collect()))
    assert a == b
    hot = [t for t in range(600) if t % 3 != 0 and t % 7 != 0]
    assert got.where("source_row = 0").count() == len(hot)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_pushes_filters_and_prunes_columns(spark):
    import __spark_entry__ as entry

    df = entry.queries()["flagship_length_band_profile"](spark, "/root/testdata/sf0.01")
    plan = _plan(df)
    assert "PushedFilters: [IsNotNull(role), EqualTo(role,assistant)" in plan
    # only the four conversation columns are read, never more
    assert "ReadSchema: struct<conv_id:bigint,turn:bigint,role:string,text:string>" in plan


def test_scan_pruned_for_narrow_query(spark):
    import __spark_entry__ as entry

    df = entry.queries()["t9_exact_sample"](spark, "/root/testdata/sf0.01")
    plan = _plan(df)
    assert "ReadSchema: struct<doc_id:bigint>" in plan  # the text column is never read
