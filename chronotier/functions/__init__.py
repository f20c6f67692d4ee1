from .labels import canonical_labels, label_map, label_tokens
from .numbers import finite, nearest_rank, ordered_key, raw_bits
from .timebuckets import bucket_start, day_number, to_millis

__all__ = [
    "bucket_start", "canonical_labels", "day_number", "finite", "label_map", "label_tokens", "nearest_rank",
    "ordered_key", "raw_bits", "to_millis",
]
