"""Query catalogue and end-to-end pipelines."""
