"""Operations of a training-data pipeline: each is one DataFrame-in, DataFrame-out function.

Nothing else in the library imports this subpackage.
"""
