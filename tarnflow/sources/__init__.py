"""Where streams come from."""

from .files import file_lines
from .iterator import from_iterable, from_table
from .kafka import KafkaSource, kafka_records
from .partitioned import PartitionedSource, StatefulPartitionedSource, register
from .spi import LinesOfFiles, StatefulSource, StatefulSourcePartition, StreamSource

__all__ = ["KafkaSource", "LinesOfFiles", "PartitionedSource", "StatefulPartitionedSource", "StatefulSource", "StatefulSourcePartition", "StreamSource", "file_lines", "from_iterable", "from_table", "kafka_records", "register"]
