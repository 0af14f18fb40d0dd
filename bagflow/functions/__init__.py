"""Aggregates and folds."""

from bagflow.functions.aggregates import (
    Aggr, bottom_k, collect, const, count, distinct_set, from_fold, from_monoid, from_reduce, integer_sum, max_, mean, min_, sum_, top_k,
)
from bagflow.functions.fold import Fold

__all__ = ["Aggr", "Fold", "bottom_k", "collect", "const", "count", "distinct_set", "from_fold", "from_monoid", "from_reduce", "integer_sum", "max_", "mean", "min_", "sum_", "top_k"]
