"""Training-data operators: ten distributed operators and the corpus pipeline built on them."""
