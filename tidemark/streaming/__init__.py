"""Monitoring a running experiment on sessions as they arrive."""
