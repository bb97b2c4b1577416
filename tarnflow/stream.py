"""A keyed, timestamped stream of records over a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY, TS, SEQ, EPOCH_BEFORE, EPOCH = "_key", "_ts", "_seq", "_epoch_before", "_epoch"
RANGE = "__range"  # which range of the order of arrival a record is in, where that is known: see plans.scan
_RESERVED = (KEY, TS, SEQ, EPOCH_BEFORE, EPOCH, RANGE)


@dataclass(frozen=True)
class Stream:
    """A lazy stream: the records' columns beside the envelope.

    ``_key`` is the record's key (absent: no key), ``_ts`` its timestamp (absent: no time), ``_seq`` its place in the order of
    arrival.  After ``generate_epochs``, ``_epoch_before`` is the epoch in force when the record arrived and ``_epoch`` the one
    after it.  Every operator returns a new stream; names of operators must be unique within a chain.
    """

    df: DataFrame
    names: frozenset[str] = frozenset()
    #: Which generator the epochs are from: streams that share it have the same epochs, as branches of a split have.
    clock: object = field(default=None, compare=False)

    # -- construction ---------------------------------------------------------------------------------------------
    def then(self, name: str, plan: Callable[[DataFrame], DataFrame]) -> Stream:
        """Appends any operator, as a function of the DataFrame."""
        if name in self.names:
            raise ValueError(f"there is an operator {name!r} already")
        return replace(self, df=plan(self.df), names=self.names | {name})

    @property
    def keyed(self) -> bool:
        return KEY in self.df.columns

    @property
    def timed(self) -> bool:
        return TS in self.df.columns

    @property
    def values(self) -> list[str]:
        return [c for c in self.df.columns if c not in _RESERVED]

    def need(self, *columns: str) -> None:
        if lacking := [c for c in columns if c not in self.df.columns]:
            raise ValueError(f"the stream has no {', '.join(lacking)}")
