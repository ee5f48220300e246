"""Sources and sinks: arrays, TIFF, stack patterns, Zarr, Parquet."""
