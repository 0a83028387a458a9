"""Runnable jobs: each module has ``run(spark, ...)``, which does the work with a given session, and a command line that makes one."""
