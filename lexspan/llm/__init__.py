"""Training-data operators. Nothing else in lexspan imports this subpackage."""
