"""Operation lists, step graphs, spec files and request logs."""
