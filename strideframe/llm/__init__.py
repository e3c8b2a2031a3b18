"""Training-data operators over documents, pages and conversations.

Nothing else in the library imports this subpackage. ``registry`` lists its queries.
"""
