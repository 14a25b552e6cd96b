"""Part of skein; see README.md."""
