"""Signal analytics on Spark: framing, spectra, descriptors, statistics, comparison and alignment as DataFrame operators."""
