"""Composed jobs: models and scoring, cross-validation, search, feature selection."""
