"""What the operators need of the cluster; see ``plumbline.cluster``."""

from plumbline.cluster import AT_ONCE, HELD, PART_BYTES, Scratch, fresh, if_few, is_empty, map_texts, others, partitions, parts, shared_dir

__all__ = ["AT_ONCE", "HELD", "PART_BYTES", "Scratch", "fresh", "if_few", "is_empty", "map_texts", "others", "partitions", "parts", "shared_dir"]
