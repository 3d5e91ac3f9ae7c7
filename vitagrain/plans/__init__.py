"""User-level pipelines composed from the operators."""
