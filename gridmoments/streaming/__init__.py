"""streaming of gridmoments."""
