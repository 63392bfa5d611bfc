"""sources of gridmoments."""
