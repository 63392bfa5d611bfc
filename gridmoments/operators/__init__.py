"""operators of gridmoments."""
