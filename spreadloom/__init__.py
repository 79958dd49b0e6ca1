"""Statement analytics as DataFrame transformations over long, typed tables."""
