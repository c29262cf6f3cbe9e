"""Report formats."""
