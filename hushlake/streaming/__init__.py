"""The same expressions over streams."""
