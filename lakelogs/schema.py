"""Table schemas of log events and load-balancer access logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import types as T

#: Label columns of a log table unless configured otherwise.
LABELS = ("env", "service", "host", "region", "app", "pod", "container", "level", "namespace")

_NTZ, _STR, _LONG = T.TimestampNTZType(), T.StringType(), T.LongType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


def label_column(name: str) -> str:
    """The column of a label; a name that has the prefix already is accepted."""
    name = name.replace("-", "_").replace(".", "_").replace(" ", "_")
    return name if name.startswith("label_") else f"label_{name}"


def log_schema(labels: Sequence[str] = LABELS) -> T.StructType:
    return _struct(
        ("log_group_name", _STR), ("log_stream_name", _STR), ("timestamp", _NTZ), ("message", _STR), ("ingestion_time", _NTZ), ("sequence_token", _LONG),
        *((label_column(c), _STR) for c in labels), ("date", _STR), ("hour", _STR),
    )


LOG_SCHEMA = log_schema()


def raw_schema(labels: Sequence[str] = LABELS) -> T.StructType:
    """A landed event: camelCase names, epoch integers of any scale, label columns; ``table`` routes mixed batches."""
    return _struct(
        ("logGroupName", _STR), ("logStreamName", _STR), ("timestamp", _LONG), ("message", _STR), ("ingestionTime", _LONG), ("sequenceToken", _LONG),
        *((label_column(c), _STR) for c in labels), ("table", _STR),
    )


RAW_SCHEMA = raw_schema()

ALB_SCHEMA = _struct(
    ("time", _NTZ), ("type", _STR), ("elb", _STR), ("client_ip", _STR), ("client_port", T.IntegerType()), ("target_ip", _STR), ("target_port", T.IntegerType()),
    ("request_processing_time", T.DoubleType()), ("target_processing_time", T.DoubleType()), ("response_processing_time", T.DoubleType()),
    ("elb_status_code", T.IntegerType()), ("target_status_code", T.IntegerType()), ("received_bytes", _LONG), ("sent_bytes", _LONG),
    ("request_method", _STR), ("request_url", _STR), ("request_path", _STR), ("request_protocol", _STR), ("user_agent", _STR),
    ("ssl_cipher", _STR), ("ssl_protocol", _STR), ("domain_name", _STR), ("actions_executed", _STR), ("redirect_url", _STR), ("error_reason", _STR), ("trace_id", _STR),
    ("ingestion_time", _NTZ), ("date", _STR), ("hour", _STR),
)
