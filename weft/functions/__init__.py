"""Part of weft; see README.md."""
