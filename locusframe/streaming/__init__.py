"""Streams of variants held against static tables."""
