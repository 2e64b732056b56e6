"""Evidence-first extraction, versioned datasets and corpus operators on PySpark."""
