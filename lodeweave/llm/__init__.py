"""Training-data operators: extraction, de-duplication, tokenising, scanning and formatting of large text corpora.

Nothing else in the library imports this subpackage; ``registry`` lists its queries and their SQL.
"""
