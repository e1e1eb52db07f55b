"""Numeric work per tree, alignment or chain: small numpy functions under grouped pandas functions."""
