"""Listing and entity intelligence as Spark DataFrame operators."""
