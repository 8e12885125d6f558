"""Column builders: classification, buckets, percentiles, text and finance formulas."""
