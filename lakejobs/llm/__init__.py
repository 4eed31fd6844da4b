"""Operations of a training-data pipeline over ``documents``, ``pages`` and ``benchmark``.

Nothing else in the library imports this package; ``queries`` registers its check queries.
"""
