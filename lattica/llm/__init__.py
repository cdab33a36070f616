"""Training-data operators: extraction, scoring, near-duplicate removal, mixing and archives.

Nothing else in the library imports this subpackage.
"""
