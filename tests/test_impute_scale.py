"""What imputers send to Python workers."""

import re

from gapmend.operators import impute as I


def test_pattern_search_sends_flat_arrays(spark, series, monkeypatch):
    """A struct for every cell would be a Python object for every cell of a batch of rows."""
    df, data = series
    cells = df.selectExpr("dataset", "CAST(0 AS BIGINT) AS cluster_id", "series_id", "t", "value")
    seen, plain = [], type(df).mapInPandas

    def spy(self, fn, schema, *args, **kwargs):
        out = plain(self, fn, schema, *args, **kwargs)
        seen.extend(f.dataType.simpleString() for d in (self, out) for f in d.schema)
        return out

    monkeypatch.setattr(type(df), "mapInPandas", spy)
    masked = I.mask_miss_perc(cells)
    out = I.impute_pattern_knn(masked, cells)
    assert seen and not [s for s in seen if re.search("struct|map", s)]
    rows = out.collect()
    assert len(rows) == masked.count() and {r.algorithm for r in rows} == {"pattern_knn"}
    assert all(r.value == data[r.dataset, r.series_id][r.t] and (r.hidden or r.imputed == r.value) for r in rows)
