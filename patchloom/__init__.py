"""Typed state-change streams on Spark: logs of patches, folded, filtered, delivered and packed."""
