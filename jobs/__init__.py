"""Runnable jobs and the queries that run each of them on the driver's tables."""

from __future__ import annotations

from jobs import demotion_sweep, label_watch

QUERIES = {"job1_demotion_sweep": demotion_sweep.job1_demotion_sweep, "job2_label_watch": label_watch.job2_label_watch}
ORACLE_SQL = {"job1_demotion_sweep": demotion_sweep.SQL, "job2_label_watch": label_watch.SQL}
