"""Listing extraction and analytics over tables of raw web pages, as Spark DataFrame plans."""
