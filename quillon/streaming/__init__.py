"""The cleaning plan on streams."""
