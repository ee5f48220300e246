"""A PySpark engine for multidimensional image records.

An image is a typed, nested value in an ordinary table: header, channels and
planes (one 2-D slice for each time, channel and depth).  The operators are
DataFrame expressions; Python runs only where bytes of image files are decoded
or encoded.
"""

__version__ = "0.1.0"
