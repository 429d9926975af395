"""Training-data operators: ten stand-alone corpus operators and their contract queries.

Nothing outside this subpackage imports it; it can be deleted as a whole.
"""
