"""Release gate for datasets: validate, measure, diff, version and publish on Spark."""

__version__ = "0.1.0"
