"""Readers of sequence, annotation, alignment and report files, and writers of results.

Text formats are read with Spark's own readers, so any store and any compression that Spark reads will do, and large
files are split.
"""
