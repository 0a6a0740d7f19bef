"""Training-data operators over the ``documents`` and ``embeddings`` tables.

Nothing else in the library imports this subpackage; it may be deleted whole.
"""
