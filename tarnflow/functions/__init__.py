"""Column functions: partitioners and time bounds."""

from .context import OperatorContext, operator_context
from .partitioners import index_select, isolate_hot, rendezvous_select
from .times import maximum, merge, minimum, try_int

__all__ = ["OperatorContext", "index_select", "isolate_hot", "maximum", "merge", "minimum", "operator_context", "rendezvous_select", "try_int"]
