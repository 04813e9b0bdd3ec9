"""Structured Streaming jobs: see :mod:`docquarry.streaming.events`."""
