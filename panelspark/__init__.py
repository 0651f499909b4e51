"""Snapshot-panel analytics on PySpark.

A panel is a table in which the same entities are measured again and again under
labelled snapshots.  Every operator here is a DataFrame pipeline, and all of them
keep one rule: an unknown value never becomes a number.
"""
