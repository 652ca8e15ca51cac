"""Mapping of band values from one sensor to another sensor or to spectra, by neighbours in a prepared library."""
