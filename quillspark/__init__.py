"""Cleaning, linking, searching and measuring a corpus of publication records on Spark."""
