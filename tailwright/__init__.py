"""Small-RNA end-modification analytics as Spark plans."""
