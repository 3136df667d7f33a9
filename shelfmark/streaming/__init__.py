"""Incremental forms of the stores."""
