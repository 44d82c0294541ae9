"""Scalar functions: spans, text, numbers, units, dates, vocabularies. Column functions first, Arrow UDFs where SQL can't."""
