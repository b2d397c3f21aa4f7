"""Training-data operators: ten corpus operators over ``documents``, ``pages`` and ``embeddings``.

Nothing else in the library imports this subpackage.
"""
