"""Relational, spatial, statistical and sequence operators."""
