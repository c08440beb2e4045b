"""Sources: the corpus manifest, files and pages, ingest state, and extraction boundaries."""
