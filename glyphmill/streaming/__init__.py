"""The stateless text functions on unbounded input."""
