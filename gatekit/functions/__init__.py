"""Column expression builders. Each returns a Column; none triggers a job."""
