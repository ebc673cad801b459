"""Scalar and window expressions shared by the operators."""
