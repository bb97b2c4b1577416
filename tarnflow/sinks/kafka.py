"""Records to Kafka.  A record's own timestamp is not sent."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..stream import Stream


def kafka_columns(stream: Stream, record: str = "value") -> DataFrame:
    """The columns that Spark's Kafka sink reads, from a column of record structs."""
    r = F.col(record)
    return stream.df.select(r["topic"].alias("topic"), r["key"].alias("key"), r["payload"].alias("value"), r["partition"].alias("partition"))


@dataclass(frozen=True)
class KafkaSink:
    brokers: tuple[str, ...] = ()
    group: str | None = None
    extra: dict = field(default_factory=dict)

    def broker(self, address: str) -> KafkaSink:
        return replace(self, brokers=(*self.brokers, address))

    def group_id(self, name: str) -> KafkaSink:
        return replace(self, group=name)

    def conf(self, name: str, value: str) -> KafkaSink:
        return replace(self, extra=self.extra | {name: value})

    def options(self) -> dict[str, str]:
        if not self.brokers:
            raise ValueError("lacking: broker")
        group = {"kafka.group.id": self.group} if self.group else {}
        return {"kafka.bootstrap.servers": ",".join(self.brokers)} | group | {f"kafka.{n}": v for n, v in self.extra.items()}

    def start(self, stream: Stream, checkpoint: str) -> StreamingQuery:
        """Sends an unbounded stream; needs Spark's Kafka connector on the class path."""
        return kafka_columns(stream).writeStream.format("kafka").options(**self.options()).option("checkpointLocation", checkpoint).start()
