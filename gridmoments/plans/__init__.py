"""plans of gridmoments."""
