"""Daily summary tables: batch job, backfill and streaming jobs."""
