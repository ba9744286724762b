"""Relational operators over integer-coded relations."""
