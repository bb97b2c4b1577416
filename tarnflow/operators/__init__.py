"""The operators: functions from streams to streams.

They are also methods of ``Stream``; this module attaches them.
"""

from ..stream import Stream
from .keyed import distribute, key_distribute, key_local, unkey
from .logic import BuildContext, StatefulLogic, StatelessLogic, built_by, stateful_op, stateless_logic
from .routing import cloned, const_cloned, const_split, split, split_tagged, union, union_frontier
from .stateful import batches, close_on_epoch, fold, running, stateful_map
from .stateless import filter_map, filter_rows, flatten, inspect, inspect_each, map_values, stateless_op
from .time import NeedsEpochs, assign_timestamps, epochs, frontier, inspect_frontier, limit_out_of_orderness
from .ttl import ttl_fold, ttl_running, ttl_window

__all__ = [
    "BuildContext", "NeedsEpochs", "StatefulLogic", "StatelessLogic", "assign_timestamps", "batches", "built_by", "cloned", "close_on_epoch", "const_cloned", "const_split", "distribute", "epochs", "filter_map", "filter_rows", "flatten", "fold", "frontier",
    "inspect", "inspect_each", "inspect_frontier", "key_distribute", "key_local", "limit_out_of_orderness", "map_values", "running", "split", "split_tagged", "stateful_map", "stateful_op", "stateless_logic", "stateless_op", "ttl_fold", "ttl_running", "ttl_window", "union", "union_frontier", "unkey",
]

for _name, _function in (
    ("map", map_values), ("filter", filter_rows), ("filter_map", filter_map), ("flatten", flatten), ("inspect", inspect), ("inspect_each", inspect_each), ("stateless_op", stateless_op),
    ("split", split), ("const_split", const_split), ("split_tagged", split_tagged), ("cloned", cloned), ("const_cloned", const_cloned), ("union", union),
    ("key_local", key_local), ("key_distribute", key_distribute), ("unkey", unkey), ("running", running), ("fold", fold), ("stateful_map", stateful_map), ("stateful_op", stateful_op), ("stateless_logic", stateless_logic), ("built_by", built_by), ("distribute", distribute), ("batches", batches),
    ("close_on_epoch", close_on_epoch), ("assign_timestamps", assign_timestamps), ("inspect_frontier", inspect_frontier), ("frontier", frontier),
    ("ttl_running", ttl_running), ("ttl_fold", ttl_fold), ("ttl_window", ttl_window),
):
    setattr(Stream, _name, _function)
