"""Column functions: time windows, canonical values, digests, text measures."""
