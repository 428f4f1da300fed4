"""Compositions: water-store models, the question catalog, guarded SQL, evaluation reports."""
