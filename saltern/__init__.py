"""Point-in-time panel analytics on Spark: plain DataFrame functions over security-by-session tables."""
