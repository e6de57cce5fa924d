"""Spark-native analytics over satellite-imagery catalogues."""
