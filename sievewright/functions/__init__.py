"""Column functions: hashing keys, cleaning, waveform arrays."""
