import re

import __spark_entry__ as entry


def test_entry_and_names(spark):
    rows = entry.entry(spark)
    assert rows.count() == 400
    found = entry.queries()
    assert set(entry.oracle_sql()) <= set(found)
    numbers = {m[1] for n in found if (m := re.match(r"op(\d+)_", n))}
    assert not numbers or numbers == {str(k) for k in range(1, 14)}
