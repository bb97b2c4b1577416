"""Kafka records as a stream: the key is the partition, the timestamp the offset."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..stream import KEY, SEQ, TS, Stream

RECORD = "struct<topic: string, partition: int, payload: binary, key: binary, timestamp: bigint>"


@dataclass(frozen=True)
class KafkaSource:
    """Options of a Kafka source, by methods that return a new one; ``options`` checks that the needed ones are there."""

    brokers: tuple[str, ...] = ()
    topic_name: str | None = None
    group: str | None = None
    offset_reset: str = "latest"
    extra: dict = field(default_factory=dict)
    timeout_seconds: int = 10

    def broker(self, address: str) -> KafkaSource:
        return replace(self, brokers=(*self.brokers, address))

    def topic(self, name: str) -> KafkaSource:
        return replace(self, topic_name=name)

    def group_id(self, name: str) -> KafkaSource:
        return replace(self, group=name)

    def auto_offset_reset(self, where: str) -> KafkaSource:
        if where not in ("earliest", "latest"):
            raise ValueError("earliest or latest")
        return replace(self, offset_reset=where)

    def conf(self, name: str, value: str) -> KafkaSource:
        return replace(self, extra=self.extra | {name: value})

    def metadata_timeout(self, seconds: int) -> KafkaSource:
        return replace(self, timeout_seconds=seconds)

    def options(self) -> dict[str, str]:
        lacking = [n for n, v in (("broker", self.brokers), ("topic", self.topic_name), ("group_id", self.group)) if not v]
        if lacking:
            raise ValueError(f"lacking: {', '.join(lacking)}")
        out = {"kafka.bootstrap.servers": ",".join(self.brokers), "subscribe": self.topic_name, "kafka.group.id": self.group, "startingOffsets": self.offset_reset}
        out["kafka.default.api.timeout.ms"] = str(self.timeout_seconds * 1000)
        return out | {f"kafka.{n}": v for n, v in self.extra.items()}

    def load(self, spark: SparkSession) -> Stream:
        """The stream; needs Spark's Kafka connector on the class path."""
        return kafka_records(spark.readStream.format("kafka").options(**self.options()).load())


def kafka_records(rows: DataFrame) -> Stream:
    """Rows of Spark's Kafka source as a stream of records; rows without a payload are skipped."""
    record = F.struct("topic", "partition", F.col("value").alias("payload"), "key", (F.unix_micros(F.col("timestamp").cast("timestamp")) / 1000).cast("long").alias("timestamp"))
    return Stream(rows.filter("value is not null").select(F.col("partition").alias(KEY), F.col("offset").alias(TS), F.col("offset").alias(SEQ), record.alias("value")))
