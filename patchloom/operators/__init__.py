"""Operators over changelogs, subscriptions, deliveries and envelopes: DataFrames in, DataFrames out."""
