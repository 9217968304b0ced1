"""Operators for preparing training text with Spark. Nothing else in tickgrid imports this subpackage."""
