"""Operators for training data of language models; nothing else imports this."""
