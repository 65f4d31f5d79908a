"""Column functions: cleaning of measurements, codes, bins."""
