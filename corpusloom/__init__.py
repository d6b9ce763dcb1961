"""Code- and text-corpus analytics as Spark plans."""
