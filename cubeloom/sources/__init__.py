"""Sources and sinks of rasters, regions and metrics."""
