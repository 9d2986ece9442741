"""Scalar functions of reports as Column -> Column. A NULL operand gives NULL unless said otherwise."""
