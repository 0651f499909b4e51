"""The questions a user asks, each composed of operators."""
