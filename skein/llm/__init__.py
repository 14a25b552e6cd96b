"""Operators for preparing training corpora; nothing else in skein imports this."""
