"""DataFrame operators, one module per layer of the pipeline."""
