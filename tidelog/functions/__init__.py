"""Scalar functions of the log: validation, checksums, binary fields, formats."""
