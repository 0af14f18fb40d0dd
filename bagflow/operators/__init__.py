"""The dataset and its operators, and tasks that run beside them."""

from bagflow.operators.dataset import Dataset
from bagflow.operators.tasks import Handle, Options, Progress, Reporter, State, Status, TaskFailed, Throttle, fork, fork_concurrently, on_cluster

__all__ = ["Dataset", "Handle", "Options", "Progress", "Reporter", "State", "Status", "TaskFailed", "Throttle", "fork", "fork_concurrently", "on_cluster"]
