"""Formulas: trees, text, rewriting, and compilation to Spark columns and numpy."""
