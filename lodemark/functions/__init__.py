"""Column functions: text, hashes and fingerprints."""
