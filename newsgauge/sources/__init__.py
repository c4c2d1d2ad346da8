"""Landing-file parsers and the stored tables."""
