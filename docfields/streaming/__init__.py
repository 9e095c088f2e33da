"""The page extraction as a stream."""
