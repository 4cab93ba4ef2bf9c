"""Procurement risk analytics written as Spark DataFrame transformations."""
