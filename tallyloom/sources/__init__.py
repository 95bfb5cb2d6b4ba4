"""Readers and writers: everything that turns files into DataFrames or back."""
