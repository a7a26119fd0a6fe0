"""Operators for preparing training data: search, filters, extraction, mixing and packing."""
