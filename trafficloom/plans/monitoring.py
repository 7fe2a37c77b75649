"""The periodic checks as a job over stored tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame

from trafficloom.operators.categorize import CategoryRules
from trafficloom.operators.monitors import byte_quota, non_work_time, uncategorized_domains
from trafficloom.plans.store import LogStore
from trafficloom.schema import CLIENT_CATEGORY_MINUTE, CLIENT_MINUTE, DOMAIN_MINUTE


def run_monitors(store: LogStore, settings: DataFrame, rules: CategoryRules, now: dt.datetime) -> None:
    """Check the last 24 hours and store what is new.

    Sums and distinct minutes do not need merged partials. Each check looks at
    the anomalies stored by others before it, so a finding is not repeated
    within its cool-down. Running again at the same ``now``, as after late
    data, finds all of the run anew and replaces it.
    """

    def known(monitor: str) -> DataFrame:
        return store.anomalies(without_run=store.run_name(monitor, now))

    categories = store.rollup(CLIENT_CATEGORY_MINUTE, merge=False)
    store.write_monitor_run("non_work_time", now, non_work_time(categories, settings, known("non_work_time"), now))
    minutes = store.rollup(CLIENT_MINUTE, merge=False)
    store.write_monitor_run("byte_quota", now, byte_quota(minutes, settings, known("byte_quota"), now))
    domain_rows = store.rollup(DOMAIN_MINUTE, merge=False)
    found = uncategorized_domains(domain_rows, settings, known("uncategorized_domain"), rules, now)
    store.write_monitor_run("uncategorized_domain", now, found)
