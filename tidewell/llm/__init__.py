"""Operators of a training-data pipeline; optional, nothing else imports them."""
