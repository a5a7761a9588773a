"""Operations for building training data: one module per operator.

Nothing outside this subpackage imports it.
"""
