"""Iterative plans: loops of DataFrame jobs whose state is a written table."""
