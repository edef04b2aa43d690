"""Training-data operators: one module per operator, plus the pipeline's shared helpers."""
