"""Operators that prepare text corpora for training; see the module of each operator."""
