"""Where desired states are written."""
