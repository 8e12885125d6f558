"""What a raw log row is: internal test, clean success, delivery anomaly or failure, and of which kind."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Row types, the models that may have no output, the bad ends of a stream, the marker of internal tests.
CONSUME, ERROR, REFUND = 2, 5, 6
NO_OUTPUT_MODELS = "(?i)embed|rerank|bge-|m3e|image|seedream|seedance"
BAD_ENDS = ("timeout", "scanner_error", "panic", "ping_fail")
TEST_MARKER = "模型测试"
VERSION = 5


@dataclass(frozen=True)
class Rules:
    """Parameters of the classification."""

    marker: str = TEST_MARKER


def is_test(rules: Rules = Rules()) -> Column:
    """Internal tests. Text and token inputs are coalesced; a null user_id on an otherwise matching error row gives null."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    ok = (F.col("type") == CONSUME) & (text("token_name") == rules.marker) & (text("content") == rules.marker)
    bad = (F.col("type") == ERROR) & (F.col("user_id") == 1) & (F.coalesce("token_id", F.lit(0)) == 0) & (text("token_name") == "") & (text("request_id") == "")
    return ok | bad


#: The details that classification reads, as texts, so that a value of another type does not lose the rest.
DETAILS = "frt string, billing_mode string, stream_status struct<end_reason: string, error_count: string>"


def with_details(logs: DataFrame) -> DataFrame:
    """The rows with ``other`` parsed once, as ``details_``; null where it is missing or no JSON."""
    return logs.withColumn("details_", F.from_json("other", DETAILS))


def _long(field: str) -> Column:
    return F.coalesce(F.col(f"details_.{field}").try_cast("long"), F.lit(0).cast("long"))


def json_text(path: str) -> Column:
    """A string of the ``other`` column; empty where it is missing or the JSON is invalid."""
    return F.coalesce(F.get_json_object("other", path), F.lit(""))


def json_long(path: str) -> Column:
    return F.coalesce(F.get_json_object("other", path).try_cast("long"), F.lit(0).cast("long"))


def zero_output() -> Column:
    return (F.col("completion_tokens") == 0) & ~F.col("model_name").rlike(NO_OUTPUT_MODELS)


def bad_stream() -> Column:
    """Of rows with details: whether the stream ended badly; a missing reason or count is none."""
    return F.coalesce("details_.stream_status.end_reason", F.lit("")).isin(*BAD_ENDS) | (_long("stream_status.error_count") > 0)


def error_kind() -> Column:
    """timeout, 5xx, 4xx or other of an error row; a null content is other."""
    text = F.lower("content")
    late = text.contains("timeout") | text.contains("deadline")
    return F.when(late, "timeout").when(text.contains("status_code=4"), "4xx").when(text.contains("status_code=5"), "5xx").otherwise("other")


def classified(logs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """User traffic (types 2 and 5 without internal tests) with outcome, zero, stream_bad, error_kind and frt."""
    zero, bad = zero_output(), bad_stream()
    rows = with_details(logs.where(F.col("type").isin(CONSUME, ERROR) & ~is_test(rules)))
    outcome = F.when(F.col("type") == ERROR, "failed").when(zero | bad, "anomaly").otherwise("success")
    return rows.withColumns({"outcome": outcome, "zero": zero, "stream_bad": bad & ~zero, "error_kind": F.when(F.col("type") == ERROR, error_kind()), "frt": _long("frt")}).drop("details_")


def test_labels(rules: Rules = Rules()) -> dict[str, Column]:
    """Origin, scope, result and cost basis of internal tests, of rows with details; empty for other rows."""
    test, tiered = F.coalesce(is_test(rules), F.lit(False)), F.coalesce("details_.billing_mode", F.lit("")) == "tiered_expr"
    label = lambda c: F.when(test, c).otherwise("")
    return {
        "origin": label(F.when(tiered, "legacy_tiered").otherwise("legacy_base")),
        "scope": label(F.lit("legacy")),
        "result": label(F.when(F.col("type") == ERROR, "failed").when(zero_output() | bad_stream(), "anomaly").otherwise("success")),
        "cost_basis": label(F.when(tiered, "legacy_after_group").otherwise("legacy_assumed_base")),
    }


#: What stored labels may say.
ORIGINS, SCOPES, BASES = ("legacy_base", "legacy_tiered"), ("single", "all"), ("legacy_assumed_base", "legacy_after_group")


def normal_labels() -> dict[str, Column]:
    """Stored labels as they are read: an unknown origin is the plain one, an unknown scope is legacy, a missing cost basis is
    the assumed one and an unknown one unsupported (it is listed, not priced)."""
    basis = F.coalesce("cost_basis", F.lit(""))
    return {
        "origin": F.when(F.col("origin").isin(*ORIGINS), F.col("origin")).otherwise(ORIGINS[0]),
        "scope": F.when(F.col("scope").isin(*SCOPES), F.col("scope")).otherwise("legacy"),
        "cost_basis": F.when(basis == "", BASES[0]).when(basis.isin(*BASES), basis).otherwise("unsupported"),
    }
