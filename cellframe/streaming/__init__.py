"""Notification streams."""
