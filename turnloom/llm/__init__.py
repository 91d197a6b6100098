"""Training-data operators: one module an operator, plus the registry in ``queries``."""
