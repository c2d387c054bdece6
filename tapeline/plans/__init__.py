"""Plans of the recording-archive library."""
