"""Table synchronisation and training-text processing as Spark jobs."""
