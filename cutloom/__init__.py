"""cutloom: media-timeline, speech, raster and outline analytics on PySpark."""

__version__ = "0.1.0"
