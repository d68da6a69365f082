"""Readers of the formats the pipeline exchanges, with the checks each one makes."""
