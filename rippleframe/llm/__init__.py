"""Training-data operators: one module for each operator, and their queries in ``registry``."""
