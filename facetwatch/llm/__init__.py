"""Training-data operators: ten corpus jobs over a documents table.

Nothing outside this subpackage imports it.
"""
