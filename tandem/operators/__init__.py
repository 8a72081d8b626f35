"""Event detection, coincidence, bundles, runs, statistics, surrogates, spectra, exposure, sensitivity and checks."""
