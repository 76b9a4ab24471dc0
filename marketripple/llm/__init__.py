"""Operators of a training-data pipeline: deduplication, tokenizers, filters, mixing. Nothing else imports this package."""
