"""functions of gridmoments."""
