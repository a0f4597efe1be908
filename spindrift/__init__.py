"""Signal features, connectivity, spectra and posterior analytics as Spark jobs over one long table."""
