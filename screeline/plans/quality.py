"""Queries on the quality of measurements."""

from __future__ import annotations

from screeline.operators.spikes import SpikeLimits, flag_faulty_fixes
from screeline.plans.registry import query
from screeline.session import table


#: All tracks lie in Colorado: readings beyond it, with some margin, belong to another place.
COLORADO = SpikeLimits(expected_lat=(36.5, 41.5), expected_lon=(-109.6, -101.5), expected_ele=(800.0, 4700.0))


@query("p1_found")
def p1_found(spark, folder):
    return flag_faulty_fixes(table(spark, folder, "trkpt"), limits=COLORADO).select("track_id", "seq_no", "pt_no")


@query("p1_faults")
def p1_faults(spark, folder):
    return flag_faulty_fixes(table(spark, folder, "trkpt"), limits=COLORADO)
