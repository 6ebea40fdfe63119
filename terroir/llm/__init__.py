"""Operators for text and record preparation of training data; nothing else imports this."""
