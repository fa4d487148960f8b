"""Where rasters, change maps and field packages are written."""
