"""Where streams go."""

from .files import write_by_key
from .kafka import KafkaSink, kafka_columns
from .memory import VecSink
from .numbered import line_numbers
from .spi import NumberedFiles, StatefulSink, StatefulSinkPartition, StatelessSink, StreamSink
from .stdout import StdOutSink, formatted, print_records

__all__ = [
    "KafkaSink", "NumberedFiles", "StatefulSink", "StatefulSinkPartition", "StatelessSink", "StdOutSink", "StreamSink", "VecSink", "formatted", "kafka_columns", "line_numbers", "print_records", "write_by_key",
]
