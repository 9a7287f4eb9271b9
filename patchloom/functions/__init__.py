"""Column functions and the binary codec."""
