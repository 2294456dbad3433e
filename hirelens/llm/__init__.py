"""Operators for preparing language-model training data.

Every operator reads only the columns that it is told to read and returns its own
columns, so extra columns of its input, whatever their names, neither reach nor
disturb the result. Nulls, empty texts and repeated rows have a result that the
operator's docstring states. Each module stands alone; ``queries`` registers them.
"""
