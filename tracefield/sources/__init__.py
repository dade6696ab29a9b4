"""Readers of trips, indexes and configurations, and writers of indexes and graphs."""
