"""Test-data jobs on Spark: profiling, subsetting, masking, loading, validation."""
