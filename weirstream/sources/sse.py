"""Server-sent events of text generators: landed lines to deltas and to tokens with their alternatives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAYLOAD = """choices array<struct<delta: struct<content: string, reasoning_content: string>,
  logprobs: struct<content: array<struct<token: string, logprob: double, top_logprobs: array<struct<token: string, logprob: double>>>>>>>"""
#: Tokens of chat templates that are no text.
TEMPLATE_TOKENS = ["<|im_end|>", "<|im_start|>", "<think>", "</think>", "<|endoftext|>", "\n</think>", "</think>\n", "<s>", "</s>"]


def payloads(lines: DataFrame) -> DataFrame:
    """stream_id, seq, event of lines (stream_id, seq, line) that carry data, up to the end mark; broken JSON is skipped."""
    data = lines.where(F.ltrim("line").startswith("data:")).select("stream_id", "seq", F.trim(F.substring(F.ltrim("line"), F.lit(6), F.length("line"))).alias("data"))
    ends = data.where("data = '[DONE]'").groupBy("stream_id").agg(F.min("seq").alias("end"))
    live = data.join(ends, "stream_id", "left").where("end is null or seq < end")
    return live.select("stream_id", "seq", F.from_json("data", PAYLOAD).alias("event")).where("event.choices is not null")


def deltas(lines: DataFrame) -> DataFrame:
    """stream_id, seq, chunk: the pieces of text."""
    content = F.get("event.choices", F.lit(0))["delta"]["content"]
    return payloads(lines).select("stream_id", "seq", content.alias("chunk")).where(F.length("chunk") > 0)


def tokens(lines: DataFrame) -> DataFrame:
    """answer_id, pos (from 0 in order), phase, token, logprob, top_logprobs; template tokens are dropped."""
    first = F.get("event.choices", F.lit(0))
    phase = F.when(F.length(first["delta"]["reasoning_content"]) > 0, "reasoning").otherwise("content")
    each = payloads(lines).select("stream_id", "seq", phase.alias("phase"), F.posexplode(first["logprobs"]["content"]).alias("j", "t"))
    kept = each.where(~F.col("t.token").isin(*TEMPLATE_TOKENS))
    listed = kept.groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("seq", "j", "phase", "t"))).alias("a"))
    return listed.select(F.col("stream_id").alias("answer_id"), F.posexplode("a").alias("pos", "x")).select("answer_id", "pos", "x.phase", "x.t.token", "x.t.logprob", "x.t.top_logprobs")
