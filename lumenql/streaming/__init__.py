"""Change logs and streams."""
