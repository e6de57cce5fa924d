"""Training-data operators: similarity joins, tokenizers, filters, redaction and linking.

Nothing else in the library imports this subpackage.
"""
