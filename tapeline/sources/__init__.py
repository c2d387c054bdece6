"""Sources of the recording-archive library."""
