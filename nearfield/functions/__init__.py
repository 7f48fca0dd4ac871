"""Column functions: vector distances, 8-bit quantization, recall."""

from .recall import percentile_index, recall
from .sq8 import sq8_distance, sq8_encode
from .vectors import l2, l2_squared

__all__ = ["l2", "l2_squared", "percentile_index", "recall", "sq8_distance", "sq8_encode"]
