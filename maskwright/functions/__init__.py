"""Column expressions: transforms, keyed functions, mocks, detectors, validators."""
