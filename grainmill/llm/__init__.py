"""Operators of a training-data pipeline over ``documents``. Nothing else in the package imports this subpackage."""
