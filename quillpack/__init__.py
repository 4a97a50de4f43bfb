"""Compact, evolvable binary records over Spark columns, with the analyses built on them."""
