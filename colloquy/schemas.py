"""Row schemas of the supervised, preference and tokenized tables."""

from __future__ import annotations

from pyspark.sql import types as T

_S = T.StringType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


CALL_FUNCTION = _struct(name=_S, arguments=_S)
# ``arguments`` is JSON text at rest; it is parsed only where a value is needed.
TOOL_CALL = _struct(id=_S, type=_S, name=_S, arguments=_S, function=CALL_FUNCTION)
MESSAGE = _struct(
    role=_S, content=_S, tool_calls=T.ArrayType(TOOL_CALL), tool_name=_S, name=_S
)
PLAIN_MESSAGE = _struct(role=_S, content=_S)

SFT_ROW = _struct(
    example_id=_S,
    session_id=_S,
    target_turn_index=T.IntegerType(),
    messages=T.ArrayType(MESSAGE),
    target_text=_S,
    target_message=MESSAGE,
    session_language=_S,
    target_mode=_S,
    source_export_ts=_S,
    cleaned_run_ts=_S,
)

DPO_REQUIRED = ("prompt", "chosen", "rejected")
DPO_ROW = _struct(
    prompt=_S,
    chosen=_S,
    rejected=_S,
    example_id=_S,
    session_id=_S,
    source_family=_S,
    source_dataset=_S,
    source_variant=_S,
    tool_contract=_S,
    scenario_type=_S,
    policy_class=_S,
)

COMPARISON_BASE = _struct(prompt=_S, vanilla=_S)
METRIC_SAMPLE = _struct(run_id=_S, ts=T.TimestampType(), key=_S, value=T.DoubleType())
