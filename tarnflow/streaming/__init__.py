"""Unbounded streams: stateful operators, runs and snapshots."""

from .operators import count_batches, ended, keyed_fold, stamp_epochs, stateful_map, stateful_op, ttl_fold
from ..plans.places import work_dir
from .runtime import Runtime, run_available
from .snapshots import committed_version, state_of, versions

__all__ = ["Runtime", "committed_version", "count_batches", "ended", "keyed_fold", "run_available", "stamp_epochs", "state_of", "stateful_map", "stateful_op", "ttl_fold", "versions", "work_dir"]
