"""Part of lexspan."""
