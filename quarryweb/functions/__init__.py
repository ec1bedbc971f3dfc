"""Column functions and worker-side functions of the extraction engine."""
