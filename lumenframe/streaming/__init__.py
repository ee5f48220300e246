"""Streams of image files: an extension beyond the batch operators."""
