"""Column functions: wire fields, buckets, tags and text forms."""
