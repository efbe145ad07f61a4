"""Operators on count matrices: filtering, normalisation, products, spectra, perturbation, robustness."""
