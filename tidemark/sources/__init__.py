"""Tables, stages, retention and compaction on partitioned Parquet."""
