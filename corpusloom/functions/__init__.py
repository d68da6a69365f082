"""See README for the contents of this subpackage."""
