"""tributary: multi-tenant marketing analytics expressed as Spark DataFrame jobs.

Many source tables flow into one hub, are unpacked into typed rows, normalised
into six star tables and answered through a semantic layer.  Every tenant shares
one DataFrame per table; ``tenant_slug`` is the partition column and part of
every grouping, window and join key.
"""
