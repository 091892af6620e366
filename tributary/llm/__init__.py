"""Operators for preparing training text: filters, scores, near duplicates, packing and scans."""
