"""Streams of arriving samples; an extra that Spark provides."""
