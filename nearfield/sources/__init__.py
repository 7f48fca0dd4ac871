"""Sources and sinks: vector CSV, derived item views, versioned snapshots, capacity."""

from .capacity import capacity
from .csv_vectors import dataset_manifest, read_vector_csv, write_vector_csv
from .items import VARIANTS, items
from .snapshot import Snapshot, build_snapshot, open_snapshot

__all__ = ["VARIANTS", "Snapshot", "build_snapshot", "capacity", "dataset_manifest", "items", "open_snapshot", "read_vector_csv", "write_vector_csv"]
