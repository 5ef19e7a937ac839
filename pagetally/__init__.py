"""pagetally: reports over sampled page-load telemetry and request logs, as Spark DataFrame plans.

functions/  Column builders (filters, rates, quantiles, statistics) and the time frame
operators/  DataFrame -> DataFrame building blocks (scan, roll-ups, access, ordering, slots)
plans/      the ready reports and table jobs built from the operators
sources/    readers, writers, snapshot tables, exports
"""
from pagetally.params import ReportParams

__all__ = ["ReportParams"]
