"""Query plans; importing the package fills the registry."""

from . import codec_queries, context_queries, file_queries, function_queries, history_queries, metric_queries, sequential_queries, stat_queries, transform_queries  # noqa: F401
