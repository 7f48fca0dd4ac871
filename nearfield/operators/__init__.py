"""Search operators: exact top-k, batches, quantized and partition-probing search, evaluation."""

from .batch import knn_join, knn_join_by_class
from .evaluate import audit, calibrate, confirm, duplicate_ids, predicate_violations, recall_by_class, throughput, truth
from .exact import filtered_top_k
from .half import half_table, half_top_k
from .ivf import IvfIndex, build_ivf, ivf_knn_join, ivf_top_k
from .percentile import column_percentile
from .quantized import quantized_top_k, sq8_statistics, sq8_table

__all__ = [
    "IvfIndex", "audit", "build_ivf", "calibrate", "column_percentile", "confirm", "duplicate_ids", "filtered_top_k", "half_table", "half_top_k", "ivf_knn_join", "ivf_top_k",
    "knn_join", "knn_join_by_class", "predicate_violations", "quantized_top_k", "recall_by_class", "sq8_statistics", "sq8_table", "throughput", "truth",
]
