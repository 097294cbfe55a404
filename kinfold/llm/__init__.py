"""Operations of a large-scale training-data pipeline, each in a module of its own.

Nothing else in ``kinfold`` imports this subpackage.
"""
