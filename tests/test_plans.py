"""Plan lint over every registered query: no cross joins, no window that
gathers all rows in one task, pruned parquet scans."""

import re

import pytest

import __spark_entry__ as E

from conftest import SF_SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    return {name: _plan(fn(spark, SF_SMALL)) for name, fn in E.queries().items()}


def test_no_cross_joins(plans):
    bad = {n for n, p in plans.items() if "CartesianProduct" in p or "BroadcastNestedLoopJoin" in p}
    assert not bad


def test_no_single_partition_window(plans):
    bad = set()
    for name, plan in plans.items():
        lines = plan.splitlines()
        for i, line in enumerate(lines):
            if re.search(r"\bWindow \[", line):
                below = "\n".join(lines[i + 1:i + 4])
                if "Exchange SinglePartition" in below:
                    bad.add(name)
    assert not bad


def test_scans_read_only_needed_columns(plans):
    # the widest table read by any query is lineitem; no plan here needs its text columns
    seen = 0
    for name, plan in plans.items():
        for m in re.finditer(r"ReadSchema: struct<([^>]*)>", plan):
            seen += 1
            assert "l_returnflag" not in m.group(1) and "l_linestatus" not in m.group(1), name
            assert "props" not in m.group(1), name
    assert seen > 20


def test_univariate_study_reads_its_input_twice(spark):
    df = E.queries()["univariate_price_on_quantity"](spark, SF_SMALL)
    assert len(df.collect()) == 13
    final = _plan(df).split("\n+- == Initial Plan ==")[0]
    # one subquery holds the fit; parameters and scores reuse it
    assert len(re.findall(r"[:+]- Subquery subquery#\d+", final)) == 1 and "ReusedSubquery" in final
