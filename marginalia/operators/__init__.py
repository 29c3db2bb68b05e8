"""Data operators: incremental processing, hot keys, references, differences."""
