"""Noisy per-frame scoreboard readings to clean play-by-play, on Spark."""
