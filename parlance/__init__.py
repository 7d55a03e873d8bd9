"""Transcript and speech-timing analytics as lazy Spark plans."""
