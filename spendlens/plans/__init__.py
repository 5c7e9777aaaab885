"""Composed jobs: model training, comparison, persistence and scoring."""
