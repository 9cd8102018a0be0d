"""larder: batch and streaming jobs for large libraries of saved content, on Spark."""
