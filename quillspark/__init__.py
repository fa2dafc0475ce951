"""Transcription analytics and corpus tools on Spark."""

from pathlib import Path


def ship(spark) -> None:
    """Python workers on this machine find the package; on a cluster it is given with --py-files."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[1]))
