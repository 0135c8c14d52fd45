"""Reading and writing response tables."""
