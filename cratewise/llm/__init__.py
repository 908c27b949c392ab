"""Training-data operators over the texts, pages and vectors that a track library keeps.

Each module holds one operator; ``queries`` maps the given tables to them. Nothing
else in the package imports this one.
"""
