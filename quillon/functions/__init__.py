"""Column functions: bands, scalars and FHIRPath."""
