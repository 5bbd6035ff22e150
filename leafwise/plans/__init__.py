"""Composed jobs: each returns one lazy DataFrame plan."""
