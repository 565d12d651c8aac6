"""Ridgeline."""
