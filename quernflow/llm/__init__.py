"""Training-data operators: ten corpus operators, their queries and their oracle SQL.

Nothing outside this subpackage imports it; deleting the folder leaves the rest of the library whole.
"""
