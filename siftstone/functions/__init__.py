"""Part of siftstone."""
