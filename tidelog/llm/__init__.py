"""Training-data operators: ten corpus components and their queries.

Nothing outside this subpackage imports it.
"""
