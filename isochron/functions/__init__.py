"""Column functions: site time, units, evapotranspiration, text and JSON."""
