"""Operators for preparing language-model training text; nothing else imports them."""
