"""Operators of a training-data pipeline: filters, de-duplication, packing, search and scans."""
