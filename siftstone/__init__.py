"""siftstone: corpus analytics as Spark plans."""
