"""Materialisation, fixpoints and label propagation shared by the iterative operators."""
