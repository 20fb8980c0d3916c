"""Training-data operators; ``queries`` lists them with their contracts."""
